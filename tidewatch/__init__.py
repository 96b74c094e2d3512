"""Security-findings analytics expressed as Spark DataFrame operators."""
