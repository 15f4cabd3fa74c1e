"""Column expressions: names and tiles, geometry, projection, arrays, seeded draws."""
