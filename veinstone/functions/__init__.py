"""Column functions: text, hashing, rules and scores as Catalyst expressions."""
