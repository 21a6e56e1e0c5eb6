"""Structured Streaming jobs: incremental event append and cart state."""
