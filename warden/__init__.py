"""Access-policy decisions as Spark DataFrame work."""
