"""Tessera: document search, link graph, history and SQL over Spark DataFrames."""
