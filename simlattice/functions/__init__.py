"""Column functions: pure expressions that stay inside Catalyst, and Arrow functions where text must be parsed."""
