"""lectern operators."""
