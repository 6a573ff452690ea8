"""Motif analytics on Spark: discovery, scoring and audit of repeated patterns in symbolic event data."""
