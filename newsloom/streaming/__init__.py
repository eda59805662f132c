"""The ingest job under Structured Streaming."""
