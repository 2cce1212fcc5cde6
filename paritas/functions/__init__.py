"""Column functions: scalar arithmetic and text rules. All of them stay in the JVM."""
