"""Whole dataflows made of the operators."""
