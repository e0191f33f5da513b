"""sources of the rental-market library."""
