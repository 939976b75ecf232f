"""Structured Streaming operators over event tables."""
