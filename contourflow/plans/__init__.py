"""Units of work, resumption and published tables."""
