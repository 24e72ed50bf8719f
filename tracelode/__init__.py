"""Analytics over timed interaction sessions, expressed as Spark DataFrame transformations."""
