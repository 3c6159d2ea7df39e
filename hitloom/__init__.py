"""hitloom: partitioned point-cloud analytics and training-data operators as Spark DataFrame jobs."""
