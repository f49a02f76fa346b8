"""A dictionary-extraction engine on Spark's DataFrame API."""
