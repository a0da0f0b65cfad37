"""scanframe.streaming."""
