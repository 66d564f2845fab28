"""textloom: text-corpus preparation, ranking and packaging as Spark DataFrame plans."""
