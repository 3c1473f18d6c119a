"""Operators of a training-data pipeline. Nothing outside this folder imports it.

Every operator takes DataFrames and column names and returns a DataFrame. It reads only the
columns it is given, so further columns of its input may have any name; results have the columns
listed in its docstring. The registered queries and their SQL are in ``tidewell.llm.queries``.
"""
