"""Biological sequence search and flat-table analytics as Spark DataFrames."""
