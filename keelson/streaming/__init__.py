"""The change feed and live state, with Structured Streaming."""
