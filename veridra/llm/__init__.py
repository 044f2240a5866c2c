"""Operators of a training-data pipeline: dedup, scoring, labelling, tokenising, formatting, packing."""
