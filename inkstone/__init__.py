"""inkstone: document-to-record processing on Spark DataFrames."""
