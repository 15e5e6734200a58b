"""Change events, snapshot refresh, de-duplication and rates on Structured Streaming."""
