"""Column functions and distributions."""
