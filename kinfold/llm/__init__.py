"""Operators for preparing language-model training data.

Each module is one operator with its own general interface; `queries.py` registers one thin query per
operator. Nothing else in the library imports this package.
"""
