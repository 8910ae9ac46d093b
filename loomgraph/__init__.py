"""Document, retrieval and knowledge-graph analytics on Spark DataFrames."""
