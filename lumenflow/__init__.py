"""Program-graph, dataflow and taint analytics on Spark DataFrames."""
