"""Column builders: every function takes columns and returns one built-in Spark expression."""
