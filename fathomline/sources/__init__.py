"""Readers and writers of price series."""
