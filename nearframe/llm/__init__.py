"""Operators of a training-data pipeline: classify, extract, archive, format, score, dedupe, decontaminate, mix.

Nothing else in the library imports this package.
"""
