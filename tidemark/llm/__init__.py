"""Operators of a training-data pipeline over documents and embeddings.

Nothing outside this subpackage imports it.  Each module holds one operator
with its general interface; :mod:`tidemark.llm.queries` derives the driver's
queries from them.
"""
