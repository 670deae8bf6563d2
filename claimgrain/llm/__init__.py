"""Operators for preparing language-model training data, and their registered queries.

Nothing else in the package imports this folder.
"""
