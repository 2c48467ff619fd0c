"""deedlens: document analytics on Spark DataFrames."""
