"""Compositions of operators, and what long plans need."""
