"""Operators for preparing text corpora: similarity joins, packing, tokenizing, scans and scoring."""
