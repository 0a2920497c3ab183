"""Readers: files, databases, and role views over the benchmark tables."""
