"""Evaluation of graded answers as Spark jobs: DataFrames in, DataFrames out."""
