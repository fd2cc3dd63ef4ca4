"""Column functions: vectors, orbits, features, bins, text."""
