"""Job-posting analytics expressed as PySpark DataFrame transformations."""
