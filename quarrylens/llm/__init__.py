"""Operators that prepare text and code for model training. Nothing outside this subpackage imports it."""
