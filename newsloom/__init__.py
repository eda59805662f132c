"""News-brief processing on Spark DataFrames: feeds in, ranked and translated briefs out."""
