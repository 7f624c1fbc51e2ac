"""Column functions and validation rules."""
