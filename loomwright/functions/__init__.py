"""Column functions: coercion, literals, identifiers, type mapping, rendering and hashing."""
