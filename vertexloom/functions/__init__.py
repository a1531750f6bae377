"""Array, segment and prefix-sum functions over DataFrames."""
