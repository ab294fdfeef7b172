"""Operators for large training-data pipelines.

The rest of the library never imports this subpackage.  Every module holds one
operator with a general interface; ``queries`` registers the contract queries.
"""
