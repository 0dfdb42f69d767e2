"""Tables, feeds and web pages as DataFrames."""
