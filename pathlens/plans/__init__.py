"""Compositions of operators: the batch build, snapshots, the query registry."""
