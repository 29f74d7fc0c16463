"""Cohort analytics on Spark: binning, grids, labels, splits, metrics and marts."""

__version__ = "0.1.0"
