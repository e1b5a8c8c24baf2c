"""Inputs: code-graph relations from tables, text logs and files."""
