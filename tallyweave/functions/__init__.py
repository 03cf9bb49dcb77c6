"""Column expressions: text, numbers, dates, units and keys. All run in the JVM."""
