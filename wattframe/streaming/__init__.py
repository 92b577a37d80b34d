"""Structured Streaming jobs over arriving readings."""
