"""Operators: validation, normalization, aggregates, joins, reads, time windows."""
