"""siteloom.streaming."""
