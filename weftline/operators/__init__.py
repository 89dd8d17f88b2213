"""Operators over graphs, candidates and workflows."""
