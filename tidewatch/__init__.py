"""Network and web threat analytics as Spark DataFrame operators.

Every operator takes DataFrames and parameters and returns a DataFrame. Nothing in the
library reads the clock, keeps global state or calls ``collect`` on data that grows with
the input.
"""
