"""Operators on corpora and vectors.  Nothing else in the library imports this subpackage."""
