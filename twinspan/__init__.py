"""Structural-duplication analytics on Spark: fingerprints, similarity joins, clusters, verdicts."""
