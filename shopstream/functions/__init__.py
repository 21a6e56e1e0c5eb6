"""Column-level helpers built only from Spark SQL built-ins (no Python UDFs)."""
