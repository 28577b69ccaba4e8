"""siteloom.functions."""
