"""Analytics over behavioural event traces, on Spark."""
