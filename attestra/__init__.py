"""Document-fidelity analytics on Spark DataFrames."""
