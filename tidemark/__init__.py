"""tidemark: point-in-time event analytics and training-data operators on PySpark."""
