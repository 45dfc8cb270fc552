"""Sources of the tissue-imaging engine."""
