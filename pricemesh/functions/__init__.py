"""Column expressions: text, attributes, identities, stores, delivery, display."""
