"""Causal, replicated add-wins sets as DataFrames."""
