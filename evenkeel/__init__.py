"""evenkeel: joins of skewed data streams on Spark, with load statistics and planned rebalancing."""
