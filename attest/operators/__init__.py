"""Joins, estimators, closures, rollups and grades over DataFrames."""
