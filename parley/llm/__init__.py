"""Operators for large-scale training-data pipelines.

Self-contained: nothing else in the library imports this subpackage. Each
operator has a module of its own with a general interface; ``queries`` holds the
registered ``opN_<name>`` queries and their DuckDB twins.
"""
