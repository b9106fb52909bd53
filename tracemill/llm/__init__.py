"""Operators that prepare training data for language models.

Nothing outside this subpackage imports it.  Each module holds one operator;
``queries`` holds the thin registered queries.
"""
