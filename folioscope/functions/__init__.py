"""Column functions: text, money and dates, geometry, JSON."""
