"""Whole plans: embedding, index building and the query client."""
