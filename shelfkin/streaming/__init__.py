"""The metric operators over Structured Streaming."""
