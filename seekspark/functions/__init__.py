"""Column expressions over texts, paths and names."""
