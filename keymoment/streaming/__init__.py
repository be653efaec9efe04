"""Streaming forms: batches to a sink, incremental caches, event-time windows."""
