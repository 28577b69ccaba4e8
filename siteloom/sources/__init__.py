"""siteloom.sources."""
