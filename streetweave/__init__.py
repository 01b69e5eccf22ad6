"""Spatial network analytics on Spark, and operators for training text."""
