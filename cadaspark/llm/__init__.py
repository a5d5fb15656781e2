"""Operators of a training-data pipeline over text corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns DataFrames; the thin
``opN_`` queries of :mod:`cadaspark.llm.queries` apply them to the ``documents`` table.
"""
