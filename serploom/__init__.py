"""serploom: search-result, page and attempt-log analytics as ordinary Spark jobs."""

__version__ = "0.1.0"
