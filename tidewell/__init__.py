"""tidewell: corpus ingest, retrieval, graph and log analytics as Spark jobs.

Every operator takes DataFrames and parameters and returns a DataFrame.
"""
