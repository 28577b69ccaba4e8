"""siteloom.plans."""
