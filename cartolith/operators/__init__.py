"""Relational operators of the document model."""
