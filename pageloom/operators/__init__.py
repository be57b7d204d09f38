"""operators of the page analytics library."""
