"""Column functions: every scorer and extractor as a native Spark expression."""
