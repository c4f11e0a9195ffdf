"""Relational operators on graphs, vectors and retrieval records."""
