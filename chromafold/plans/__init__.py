"""Whole plans: the fitted pipeline, the standard data sets and the query catalogue."""
