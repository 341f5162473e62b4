"""Column functions: text rules and tensor-shaped expressions."""
