"""scanframe.plans."""
