"""Document-memory analytics on Spark: classify, chunk, link, project, retrieve, evaluate."""
