"""Record linkage, deduplication, routing, catalogue and aggregation jobs on DataFrames."""
