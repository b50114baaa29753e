"""Readers of raw feed pages and lists."""
