"""codeweave: code-graph analytics, text and vector retrieval and corpus processing on Spark DataFrames."""
