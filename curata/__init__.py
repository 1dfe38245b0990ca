"""Document curation and evaluation analytics on Spark."""
