"""operators of the rental-market library."""
