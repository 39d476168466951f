"""Structured Streaming jobs; each has a batch twin that the tests compare it with."""
