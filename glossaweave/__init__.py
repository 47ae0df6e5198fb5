"""A localization and segmentation engine on Spark DataFrames."""
