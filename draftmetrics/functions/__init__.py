"""Column functions: text, html, scalars and vectors, all evaluated in the JVM."""
