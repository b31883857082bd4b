"""Readers of decisions, texts, names, logs and documents."""
