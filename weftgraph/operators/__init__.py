"""Operators on graph, text, vector and evaluation tables."""
