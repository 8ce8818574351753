"""Reusable DataFrame -> DataFrame steps (labels, runs, spend, summaries, joins)."""
