"""Column functions: no UDFs, everything stays inside whole-stage code generation or JVM expressions."""
