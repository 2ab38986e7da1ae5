"""Operators for preparing language-model training data.

Nothing outside this folder imports it; the rest of the library works without it.
"""
