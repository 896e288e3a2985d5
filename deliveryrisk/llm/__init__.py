"""Operators for cleaning and assembling training corpora.

Nothing else in the library imports this subpackage.
"""
