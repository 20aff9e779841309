"""Analytics over aerial target-tracking records, expressed as Spark DataFrame plans."""
