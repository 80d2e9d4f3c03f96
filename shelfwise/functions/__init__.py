"""Column expressions: text cleaning, weights, tags, URLs, page text."""
