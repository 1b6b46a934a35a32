"""ordinata: ordered, nested list queries compiled to plain Spark DataFrame plans."""
