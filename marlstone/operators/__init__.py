"""Relational operators of the detection-data engine."""
