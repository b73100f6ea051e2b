"""Operators of a training-data pipeline: dedup, scoring, mixing, encoding, archives, rules."""
