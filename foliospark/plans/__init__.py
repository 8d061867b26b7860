"""The registry of queries."""
