"""Analytics over multi-stream frame recordings, expressed as Spark plans."""
