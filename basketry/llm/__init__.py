"""Corpus operators for training-data pipelines: tokens, shards, quality, matching, near copies."""
