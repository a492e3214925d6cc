"""Column expressions: glob patterns, byte strings, counters."""
