"""Market panels, news analytics and training-data operators on Spark DataFrames."""
