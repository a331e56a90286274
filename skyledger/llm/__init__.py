"""Training-data operators: ten corpus operators on Spark DataFrames, each in a module of its own."""
