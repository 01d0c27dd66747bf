"""Frame-sequence and sheet analytics as Spark DataFrame operators."""
