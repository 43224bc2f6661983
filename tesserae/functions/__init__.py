"""Column functions on text, vectors and HTML."""
