"""Structured Streaming forms of the panels."""
