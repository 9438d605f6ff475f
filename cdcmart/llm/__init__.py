"""Operators that prepare training data: text, documents, pages and mixtures."""
