"""Column expressions; everything stays JVM-side."""
