"""Column builders, all of them built-in expressions."""
