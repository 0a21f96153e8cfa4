"""Column functions: value maps, casts, transforms."""
