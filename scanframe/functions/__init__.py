"""scanframe.functions."""
