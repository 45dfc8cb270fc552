"""Streaming of the tissue-imaging engine."""
