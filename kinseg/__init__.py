"""Trio copy-number segmentation as Spark DataFrame jobs."""
