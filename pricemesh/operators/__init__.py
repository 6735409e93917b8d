"""Table-level operators: matching, grouping, roll-ups, search, ranking, ingest."""
