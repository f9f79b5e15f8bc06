"""Reusable relational steps (clean view, quality checks, load, keys, joins, top-k)."""
