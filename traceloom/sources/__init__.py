"""Readers that turn stored tables into canonical trace tables."""
