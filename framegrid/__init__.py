"""framegrid: frame-aware sampled data on Spark DataFrames."""
