"""Operators for text and vector corpora of training pipelines. Nothing outside this package imports it."""
