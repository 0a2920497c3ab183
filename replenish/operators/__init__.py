"""Frame operators of the planning model (one module per family)."""
