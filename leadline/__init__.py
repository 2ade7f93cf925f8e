"""Player-tracking analytics as Spark DataFrame plans."""
