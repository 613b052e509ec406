"""Operators over events and folded spans; each takes and returns DataFrames."""
