"""Vocabulary, graph, coloring, encoder and report operators."""
