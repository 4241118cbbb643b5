"""Column expressions and the Arrow UDFs that Catalyst has no expression for."""
