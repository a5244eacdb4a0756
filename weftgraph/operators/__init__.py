"""Operators on node, edge and record tables."""
