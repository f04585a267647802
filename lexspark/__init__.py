"""Text analytics over Spark DataFrames: sources, search, clustering, topics, keywords, grading."""
