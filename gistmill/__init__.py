"""gistmill: corpus and topic analytics as Spark DataFrame operators."""
