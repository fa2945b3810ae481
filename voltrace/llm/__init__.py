"""Operators for preparing language-model training corpora.

Self-contained: nothing else in ``voltrace`` imports this subpackage, and it
imports nothing from the rest of the library.
"""
