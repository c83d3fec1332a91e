"""Financial-crime analytics as Spark DataFrame operators."""
