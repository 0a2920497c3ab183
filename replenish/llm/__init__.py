"""Operators of a large-scale training-data pipeline (see ``queries.py``).

Nothing else in the library imports this subpackage."""
