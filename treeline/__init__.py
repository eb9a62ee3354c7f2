"""Treeline: canopy analytics on Spark.

Point clouds of single trees become fixed structural descriptors, fixed
classifiers are validated by group, and every step is a DataFrame plan.
"""
