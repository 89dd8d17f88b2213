"""Operators for building language-model training corpora.

Self-contained: nothing else in the library imports this subpackage.
"""
