"""Analytics over sequences and text as declarative Spark plans."""
