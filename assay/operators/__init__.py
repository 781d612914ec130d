"""Operators on labelled tables."""
