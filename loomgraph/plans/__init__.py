"""Compositions of operators, and the queries that the driver runs."""
