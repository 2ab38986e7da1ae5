"""Column expressions over ordered series."""
