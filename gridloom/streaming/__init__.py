"""The operators that need a different form on an unbounded input."""
