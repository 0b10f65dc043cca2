"""Helpers that shape Spark plans: lineage cuts and iterative joins."""
