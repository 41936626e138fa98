"""Jobs of the library: DataFrame in, DataFrame out."""
