"""Column-level helpers (pure Catalyst expressions) and the opt-in Python cell UDF."""
