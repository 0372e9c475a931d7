"""Segmentation of ordered signals and analysis of the texts made from them, on Spark."""
