"""Review analytics as Spark DataFrame transformations."""
