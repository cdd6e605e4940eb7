"""Relational, state and queue operators over DataFrames."""
