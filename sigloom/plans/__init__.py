"""The finished feeds, composed from the operators."""
