"""Column expressions: text rules, labels, scores."""
