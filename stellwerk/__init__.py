"""Job-posting analytics as Spark DataFrame operators."""
