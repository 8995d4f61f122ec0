"""Operators for large training corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface over DataFrames; ``queries`` binds the operators to
the tables of a data directory.
"""
