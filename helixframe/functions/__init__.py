"""Column builders: every function takes and returns ``pyspark.sql.Column`` (JVM-side expressions)."""
