"""Operators for preparing language-model training corpora.

Self-contained: nothing else in the library imports this subpackage.
"""
