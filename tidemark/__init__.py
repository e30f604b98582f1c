"""tidemark: a web-analytics engine expressed as Spark DataFrame plans."""
