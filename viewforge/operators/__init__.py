"""Operators over views, partition state, lineage and catalogue tables."""
