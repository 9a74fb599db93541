"""The engine as Structured Streaming jobs."""
