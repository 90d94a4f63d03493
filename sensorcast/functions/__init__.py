"""Column expressions. Each takes columns and returns a column; all run inside the JVM."""
