"""The three analysis paths, and the registered queries over the given tables."""
