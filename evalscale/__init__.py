"""evalscale: analytics over sampled-answer evaluation logs, on Spark DataFrames."""
