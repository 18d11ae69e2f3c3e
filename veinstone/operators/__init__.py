"""DataFrame operators of the evidence engine."""
