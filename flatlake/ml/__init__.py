"""ml of the rental-market library."""
