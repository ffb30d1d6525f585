"""Treeline: a code-intelligence query engine on PySpark DataFrames."""
