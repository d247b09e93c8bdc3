"""Scalar building blocks as column expressions."""
