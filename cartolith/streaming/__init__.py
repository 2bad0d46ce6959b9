"""Incremental ingestion and event-time windows."""
