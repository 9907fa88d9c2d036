"""Operators for text and record work that language-model data needs. Nothing outside this package imports it."""
