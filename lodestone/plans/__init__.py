"""Whole flows made of operators, and the sizing of joins."""
