"""Codecs and file sources."""
