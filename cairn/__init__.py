"""Cairn: productivity and self-assessment records of many users, on Spark.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns). Nothing reads the wall clock: the day a question is asked about is
always an argument.
"""

__version__ = "0.1.0"
