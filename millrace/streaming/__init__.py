"""Streams of newly extracted edges into stored tables."""
