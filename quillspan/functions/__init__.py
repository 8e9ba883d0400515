"""Column functions and the few Arrow functions for what Spark has no built-in."""
