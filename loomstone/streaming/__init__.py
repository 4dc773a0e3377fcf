"""Structured Streaming: consumer groups with acknowledgement, change feeds, windowed aggregates, expiry."""
