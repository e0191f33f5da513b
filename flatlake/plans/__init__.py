"""plans of the rental-market library."""
