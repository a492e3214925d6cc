"""Replay of the operation log into states, and the registered queries."""
