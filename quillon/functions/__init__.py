"""Column functions: text, vectors and scores."""
