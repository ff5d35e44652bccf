"""Operators for preparing large training corpora.

Every module holds one operator as DataFrame in, DataFrame out; ``queries``
binds them to the test tables.  Nothing else in the library imports this
subpackage.
"""
