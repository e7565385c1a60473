"""Composite analytics built from operators."""
