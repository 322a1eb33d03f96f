"""Operators for training-data pipelines: packing, decontamination, secret scans, scoring and near-duplicates."""
