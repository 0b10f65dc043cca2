"""Column functions: geometry, time, tiers."""
