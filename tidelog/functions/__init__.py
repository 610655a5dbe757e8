"""Column helpers and skew-safe joins shared by the operators."""
