"""Experiment-run analytics as Spark DataFrame operators.

Every operator takes DataFrames and parameters and returns a lazy DataFrame.
"""
