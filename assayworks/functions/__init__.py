"""Column functions; all of them stay inside the JVM."""
