"""Assembled plans: the lazy planning model and the query catalogue."""
