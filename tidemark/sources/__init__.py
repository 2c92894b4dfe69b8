"""Readers and normalisers: each yields the canonical document table."""
