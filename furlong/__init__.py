"""furlong: point-in-time analytics as Spark DataFrame plans."""
