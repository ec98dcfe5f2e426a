"""Readers and writers of rasters, result logs and plans."""
