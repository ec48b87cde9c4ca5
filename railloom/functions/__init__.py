"""Column functions: parsing, normalising, geometry, scoring."""
