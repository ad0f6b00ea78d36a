"""Operators of the schedule library."""
