"""Operators for training-data pipelines: near duplicates, fingerprints, packing, quality, search, scans and token files."""
