"""Column functions: texts, URLs, times, scores. All are built-in Spark expressions."""
