"""Rule analytics on Spark: see the README."""
