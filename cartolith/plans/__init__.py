"""The document model over concrete tables, and the query catalogue."""
