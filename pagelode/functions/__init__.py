"""Column-level building blocks: text and vector expressions that stay inside the JVM."""
