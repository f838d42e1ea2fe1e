"""Column expressions: no data is touched here."""
