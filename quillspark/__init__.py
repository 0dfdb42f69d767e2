"""quillspark: document analytics, retrieval and corpus preparation on PySpark DataFrames."""
