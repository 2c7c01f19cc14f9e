"""tessera: dataflow, graph and iterative analytics on Spark DataFrames."""
