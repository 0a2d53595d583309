"""Genealogical record processing as Spark DataFrame and Structured Streaming jobs."""
