"""Graph, text and training-data analytics expressed as Spark DataFrame plans."""
