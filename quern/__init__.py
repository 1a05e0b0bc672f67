"""quern: corpus analytics as Spark DataFrame, SQL and Structured Streaming plans."""
