"""Column expressions: patterns, text, shapes of names and numbers, rectangles."""
