"""Operators for preparing large training corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames, keeps its own general interface and is driven by a thin
``opN_<name>`` query in :mod:`textloom.llm.queries`.
"""
