"""Column functions: text, geometry and JSON payload helpers."""
