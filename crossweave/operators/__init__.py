"""Relational and graph operators; each takes and returns DataFrames."""
