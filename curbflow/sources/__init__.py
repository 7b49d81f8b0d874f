"""Readers, samplers and file reports."""
