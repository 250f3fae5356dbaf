"""Column functions: text rules, fixed code tables, numeric helpers."""
