"""Writers for planning results (K1-K6)."""
