"""Whole jobs from the operators."""
