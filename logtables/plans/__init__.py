"""Named jobs over the given tables."""
