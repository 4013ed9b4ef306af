"""kinotable: timed media containers as Spark tables."""
