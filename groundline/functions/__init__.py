"""Column expressions: each takes and gives columns and knows nothing of tables."""
