"""Operators for training-data corpora: extraction, matching, filters, classifiers, archives and tokens.

Nothing outside this subpackage imports it.
"""
