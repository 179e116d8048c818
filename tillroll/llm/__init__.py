"""Operators that prepare text corpora for language-model training.

Each module holds one operator with a general interface (DataFrames in,
DataFrames out); ``queries`` applies them to the given tables and
``oracle`` holds the DuckDB SQL of those that SQL can express.
"""
