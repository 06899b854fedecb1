"""cliploom: analytics over recorded clips, bursts, packets and samples, on Spark DataFrames."""
