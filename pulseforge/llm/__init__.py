"""Operators for building language-model training corpora, and the queries that apply them."""
