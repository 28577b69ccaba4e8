"""siteloom.operators."""
