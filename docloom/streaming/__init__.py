"""Structured Streaming forms of replay and framing."""
