"""Column-to-Column building blocks, all evaluated inside the JVM."""
