"""Column expressions: geometry, thresholds, labels."""
