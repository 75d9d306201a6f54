"""Independent statements of what the queries return."""
