"""sparkloom: retrieval, grounding and evaluation analytics on Spark DataFrames."""
