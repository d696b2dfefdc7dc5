"""Set algebra and column search as lazy Spark DataFrame plans."""
