"""Structured Streaming jobs over request and run events; each has a batch twin that its tests compare it with."""
