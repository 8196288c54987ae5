"""Column builders and small vectorised functions."""
