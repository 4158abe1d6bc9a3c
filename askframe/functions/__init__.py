"""Column expressions that stay inside the JVM."""
