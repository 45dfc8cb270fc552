"""Plans of the tissue-imaging engine."""
