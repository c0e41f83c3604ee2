"""Media provenance analytics as Spark DataFrame and Structured Streaming operators."""
