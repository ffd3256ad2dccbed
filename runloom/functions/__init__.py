"""Column expressions: names, texts, identifiers, labels, resources."""
