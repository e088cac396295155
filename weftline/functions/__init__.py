"""Column functions: text, names and directions."""
