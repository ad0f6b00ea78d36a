"""Jobs of the schedule library."""
