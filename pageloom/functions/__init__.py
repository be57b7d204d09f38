"""functions of the page analytics library."""
