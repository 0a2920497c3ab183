"""Structured Streaming queries (daily demand, spike watch)."""
