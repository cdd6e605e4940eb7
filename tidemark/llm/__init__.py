"""Operators of a training-data pipeline: quality, packing, toxicity, near-dedup, language model, secrets, BPE, embeddings."""
