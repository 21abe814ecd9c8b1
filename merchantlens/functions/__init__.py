"""Column-level building blocks: dates, ratios, fixed business values."""
