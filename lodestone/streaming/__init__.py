"""Structured Streaming forms: requirements as they arrive, and audit events by time."""
