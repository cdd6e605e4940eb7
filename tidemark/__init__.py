"""Spark-native evidence and discovery engine: operators, functions, sources, plans and streams over DataFrames."""
