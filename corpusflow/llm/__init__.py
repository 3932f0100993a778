"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  ``queries.QUERIES`` and
``queries.ORACLE`` hold the registered queries and their SQL; ``corpus_pipeline.py`` at the repository top
chains five of the operators.
"""
