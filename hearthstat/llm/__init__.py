"""Operators of a training-data pipeline: dedup, secrets, token files, archives, toxicity, mixing, chat, vectors, pieces."""
