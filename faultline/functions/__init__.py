"""Column -> Column functions; stateless, so they also run on streaming DataFrames."""
