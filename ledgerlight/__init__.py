"""Document evidence and figure reconciliation on Spark DataFrames."""
