"""Media-library analytics as Spark DataFrame transformations."""
