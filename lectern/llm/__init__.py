"""Operators that prepare text corpora for training: deduplication, extraction, scans, tokenization, joins, scoring."""
