"""Analytics over the memory of many conversations at once, on Spark."""
