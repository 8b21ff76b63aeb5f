"""Change-aware analytics over listing-style data, written as Spark jobs."""
