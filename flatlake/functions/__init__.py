"""functions of the rental-market library."""
