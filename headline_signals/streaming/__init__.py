"""Structured Streaming forms of the refresh (X4) and of the daily index."""
