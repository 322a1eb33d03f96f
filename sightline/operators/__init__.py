"""Detectors, timelines, matching and reports on DataFrames."""
