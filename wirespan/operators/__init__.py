"""Operators over the engine's tables; each takes and returns DataFrames."""
