"""Column helpers for JSON values, pointers, formats and sizes."""
