"""DataFrame operators: decode, dedup, lateness, aggregates and metric analytics."""
