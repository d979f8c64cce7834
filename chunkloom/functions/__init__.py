"""Column expressions (JVM-side) and the few vectorised Python functions that Spark has no expression for."""
