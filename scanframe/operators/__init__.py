"""scanframe.operators."""
