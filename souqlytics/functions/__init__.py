"""Column-level building blocks. Everything here maps Column -> Column."""
