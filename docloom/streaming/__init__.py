"""Incremental jobs on file streams."""
