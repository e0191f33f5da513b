"""streaming of the rental-market library."""
