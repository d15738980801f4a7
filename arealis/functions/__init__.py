"""Column-level functions; everything here stays inside Spark expressions."""
