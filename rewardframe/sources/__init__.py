"""Reading and writing sample tables."""
