"""Operators for preparing language-model training text, one module each.

Nothing else in the library imports this package.
"""
