"""Raster, graph, polyline, check and statistics operators over DataFrames."""
