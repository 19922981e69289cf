"""Column expressions of the risk model."""
