"""Signal, interval and scoring analytics on PySpark."""
