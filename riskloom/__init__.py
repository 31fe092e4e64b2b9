"""riskloom: supply-chain risk-event analytics on Spark DataFrames."""
