"""folioframe: document analytics over Spark DataFrames."""
