"""Column functions: geometry, text, coordinate systems; Arrow functions only where Spark has none."""
