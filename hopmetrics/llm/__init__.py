"""Operators that prepare training data for language models, each with its query."""
