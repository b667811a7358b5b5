"""Operators for preparing language-model training text: each works on whole Spark tables."""
