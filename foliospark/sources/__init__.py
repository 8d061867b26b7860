"""Readers of containers, chunk files and logs."""
