"""Composite jobs: the generic run, state snapshots and the query registry."""
