"""Corpus preparation for language-model training: ten operators over text tables."""
