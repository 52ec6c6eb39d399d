"""Scalar text, time and JSON functions as Column expressions."""
