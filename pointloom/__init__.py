"""DataFrame operators for point scenes and the tables around them."""
