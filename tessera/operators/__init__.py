"""Operators of the tissue-imaging engine."""
