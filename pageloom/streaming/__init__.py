"""streaming of the page analytics library."""
