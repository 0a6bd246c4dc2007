"""Readers of requirement files, document folders and evaluation sets."""
