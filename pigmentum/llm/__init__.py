"""Operators for training-data pipelines over text, web pages and vectors.

Nothing outside this subpackage imports it; each module works alone on a DataFrame.
"""
