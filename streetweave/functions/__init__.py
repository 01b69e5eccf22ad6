"""Column expressions: geometry, styles and time profiles."""
