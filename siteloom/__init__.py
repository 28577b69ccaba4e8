"""siteloom: site-index analytics as PySpark DataFrame operators."""
