"""DataFrame transforms. Every one runs unchanged in batch and in Structured Streaming."""
