"""Operators for training data: scoring, deduplication, decontamination, archives and mixing."""
