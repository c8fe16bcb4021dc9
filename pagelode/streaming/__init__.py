"""Progressive indexing with Structured Streaming."""
