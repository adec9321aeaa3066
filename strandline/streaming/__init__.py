"""The stateless operators applied to file streams."""
