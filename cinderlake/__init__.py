"""cinderlake: task analytics, code retrieval and training-data operators on Spark DataFrames."""
