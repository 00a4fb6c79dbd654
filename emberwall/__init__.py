"""emberwall: packet-filter log analytics expressed as Spark DataFrames."""
