"""Analytics for document knowledge bases, as Spark DataFrame and streaming queries."""
