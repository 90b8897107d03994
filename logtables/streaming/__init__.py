"""The operators on unbounded input."""
