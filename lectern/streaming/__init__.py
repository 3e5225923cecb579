"""lectern streaming."""
