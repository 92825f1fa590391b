"""quern: a Spark-first engine for program-analysis style data processing."""
