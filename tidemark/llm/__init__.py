"""Operators for large-scale training-data pipelines, one module each.

``queries.py`` derives the digest columns of the ``opN_*`` queries from the
operators; nothing outside this subpackage imports it.
"""
