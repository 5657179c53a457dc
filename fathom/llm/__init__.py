"""Operators of a training-data pipeline over raw documents (dedup, filtering, mixing, labelling)."""
