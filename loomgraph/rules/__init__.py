"""Threshold rules as data, evaluated over feature tables that are built once."""
