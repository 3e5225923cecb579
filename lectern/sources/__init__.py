"""lectern sources."""
