"""Operators of a training-data pipeline: scoring, filtering, counting, removing copies, mixing."""
