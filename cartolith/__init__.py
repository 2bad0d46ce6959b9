"""Analytics over document landscapes, expressed as Spark plans."""
