"""Analytics over repeatedly sampled traces, expressed on Spark."""
