"""Streams of series held against constraints."""
