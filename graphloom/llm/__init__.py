"""Corpus preparation for language-model training: ten operators over documents, pages and vectors.

Nothing else in the package imports this subpackage.
"""
