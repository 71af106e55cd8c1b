"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries`` in :mod:`plumbline.llm.queries` binds them to
the tables of a folder.
"""
