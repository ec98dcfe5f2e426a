"""contourflow: terrain, graph, alignment and training-data analytics on Spark."""
