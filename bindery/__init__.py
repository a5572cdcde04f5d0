"""bindery: document-library and markup analytics on Spark DataFrames."""
