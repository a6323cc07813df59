"""Versioned key-value analytics on Spark: an operation log read as of any operation id."""
