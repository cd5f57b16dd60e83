"""Operators for building training corpora; nothing else in sparrowdex imports this package."""
