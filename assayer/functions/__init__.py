"""Column expressions and small vectorised helpers shared by the operators."""
