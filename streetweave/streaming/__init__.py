"""Entries that arrive as a stream, snapped to a fixed network."""
