"""sources of the page analytics library."""
