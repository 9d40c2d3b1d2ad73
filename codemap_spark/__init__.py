"""A code-orientation and relevance engine on Spark DataFrames."""
