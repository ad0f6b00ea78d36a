"""Sources of the schedule library."""
