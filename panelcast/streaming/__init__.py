"""Structured Streaming forms of upload ingestion and alert suppression."""
