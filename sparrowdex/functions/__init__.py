"""Column expressions: analysis, proximity, passages, answers."""
