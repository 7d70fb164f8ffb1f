"""Survey-weighted and small-area analytics as Spark DataFrame operators."""
