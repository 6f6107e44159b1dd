"""Small-area health analytics as Spark DataFrame operators."""
