"""Column functions: text keys, grams, line joins and small helpers, all native unless stated."""
