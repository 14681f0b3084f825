"""Text search, page analytics and corpus preparation as Spark DataFrame operators."""
