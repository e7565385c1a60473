"""Operators: pure DataFrame functions."""
