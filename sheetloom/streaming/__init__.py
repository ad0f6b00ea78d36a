"""Streaming of the schedule library."""
