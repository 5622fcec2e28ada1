"""Column functions: text, identifiers, vectors, geography."""
