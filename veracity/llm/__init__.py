"""Operators of a training-data pipeline: near-dedup, search, packing, scans,
tokenised output, mixing, classifiers and archive conversion.

Nothing else in the library imports this subpackage.
"""
