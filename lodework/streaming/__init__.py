"""Streaming of the toolkit."""
