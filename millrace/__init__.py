"""Star-schema analytics, encodings, trace analytics and workload tools on Spark DataFrames."""
