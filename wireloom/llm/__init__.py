"""Operators for training-data pipelines: duplicates, secrets, quality, toxicity, decontamination, personal data, tokens and language models."""
