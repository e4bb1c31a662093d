"""veil: finding, curating, removing and auditing personal data with Spark."""
