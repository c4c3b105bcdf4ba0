"""Streams of captured pairs."""
