"""Point-cloud operators: lazy functions from DataFrames to DataFrames."""
