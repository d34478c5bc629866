"""Market-event analytics on Spark: canonical trades and quotes, deterministic replay, per-symbol features."""
