"""Analytics over arrays and frames, expressed as Spark DataFrames with explicit index columns."""
