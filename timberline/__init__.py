"""timberline: multi-version keyed tables on PySpark DataFrames."""
