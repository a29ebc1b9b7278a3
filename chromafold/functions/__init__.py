"""Column functions on words, keys, targets and numbers."""
