"""Operator chains, the query registry and the oracle SQL."""
