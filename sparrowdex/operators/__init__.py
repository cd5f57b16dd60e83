"""Relational operators: index, retrieval, ranking, feedback, features, evaluation."""
