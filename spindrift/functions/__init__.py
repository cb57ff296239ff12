"""Column-returning helpers; everything here stays inside the JVM."""
