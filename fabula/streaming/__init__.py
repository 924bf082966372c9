"""Task progress, usage and token feeds as Structured Streaming queries."""
