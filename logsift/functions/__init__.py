"""Column functions: text in, text or numbers out, all inside the JVM."""
