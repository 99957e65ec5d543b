"""Document and service-traffic analytics as Spark DataFrame operators."""
