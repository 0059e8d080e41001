"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Operators take and return
DataFrames; :mod:`tracewell.llm.queries` derives the registered queries from them.
"""
