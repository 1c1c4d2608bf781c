"""Message streams on Structured Streaming."""
