"""Training-data operators: each works on whole tables as partitioned Spark jobs."""
