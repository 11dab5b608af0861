"""Operators for text corpora: dedup, decontamination, filters, tokens, archives."""
