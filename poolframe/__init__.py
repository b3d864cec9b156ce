"""Resource graphs, capacity timelines and queue policies as PySpark DataFrames."""
