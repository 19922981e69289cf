"""DataFrame operators of the risk model."""
