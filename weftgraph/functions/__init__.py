"""Column expressions and the few row functions that need Python."""
