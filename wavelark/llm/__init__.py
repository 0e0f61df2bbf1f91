"""Corpus-preparation operators for large language-model training data."""
