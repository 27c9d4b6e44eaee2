"""Column expressions and the pluggable models."""
