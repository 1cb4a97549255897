"""Document intelligence and hybrid retrieval as Spark jobs."""
