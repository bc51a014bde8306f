"""Column functions and the few vectorized helpers."""
