"""Incremental maintenance of price tables."""
