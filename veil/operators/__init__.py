"""DataFrame to DataFrame: spans, detectors, layout, candidates, checks."""
