"""Readers of item tables, detections, transcripts, pick lists and query files."""
