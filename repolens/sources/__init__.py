"""Files, documents, commit logs and rule files as DataFrames."""
