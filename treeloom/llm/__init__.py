"""Operators for building language-model training data.

Nothing else in the library imports this subpackage; it can be removed without
affecting the rest.  Every operator is a function from DataFrames to a
DataFrame; :mod:`treeloom.llm.queries` derives the registered queries.
"""
