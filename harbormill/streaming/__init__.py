"""Incremental variants of the counting operators."""
