"""Spark jobs that turn messy spreadsheet grids into clean, typed product tables."""
