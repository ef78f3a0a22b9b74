"""Operators that prepare text and vectors for training. Nothing outside this folder imports it."""
