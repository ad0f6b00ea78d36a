"""Functions of the schedule library."""
