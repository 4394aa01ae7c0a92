"""Spark-native analytics over data-pipeline incidents.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns).  Nothing runs until a sink or an action is called, apart from the few
one-row probes that the docstrings name.
"""
