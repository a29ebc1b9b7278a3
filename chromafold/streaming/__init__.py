"""Encoding of streams with a fitted dictionary."""
