"""lectern plans."""
