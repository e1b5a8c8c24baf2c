"""Operators over a CodeGraph: DataFrame in, DataFrame out."""
