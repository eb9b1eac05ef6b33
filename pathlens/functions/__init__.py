"""Column expressions and small composite helpers (all JVM-side built-ins)."""
