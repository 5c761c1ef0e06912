"""tapline: passive network telemetry analytics as Spark DataFrame operators."""
