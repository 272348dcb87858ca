"""Operators of the toolkit."""
