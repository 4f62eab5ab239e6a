"""Behavioural time series on Spark: pose tracks, outlines, bouts, spectra and state models as DataFrames."""
