"""Operators on DataFrames: search, incremental merge, registries, budgets, graphs."""
