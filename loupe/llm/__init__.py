"""Operators for training-data pipelines (toxicity, quality, deduplication, tokens, mixing, chat)."""
