"""Operators over hooks, findings, traffic and stored tables."""
