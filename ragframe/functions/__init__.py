"""Column functions (all JVM-side) and model providers."""
