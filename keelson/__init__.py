"""Typed collections (ordered key/value, list, set, sorted set) as an operation log on Spark."""
