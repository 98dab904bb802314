"""Unsupervised analytics over wide feature tables, as plain Spark jobs.

Layers
------
functions   column roles, exact quantiles, value ranks, formatting
sources     readers, writers, the synthetic expression table
operators   DataFrame -> DataFrame operators
plans       fitted, re-appliable objects and the per-run workspace
"""
