"""Streams: ingestion by file source, and windows over events."""
