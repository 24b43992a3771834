"""brindle: a log and event analytics engine on Spark DataFrames."""
