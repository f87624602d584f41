"""Column expressions: geometry, time and small formulas."""
