"""scanframe.sources."""
