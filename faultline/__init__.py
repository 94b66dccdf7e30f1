"""Function-level vulnerability assessment data work, expressed as Spark DataFrame operators."""
