"""Indexes that follow a stream of file changes."""
