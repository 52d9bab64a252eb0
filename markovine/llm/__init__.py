"""Operators for preparing language-model training data.

Each module holds one operator with a general interface; ``registry`` binds the
operators to the synthetic tables.  Nothing outside this subpackage imports it.
"""
