"""Column-level functions: text rules, rule chains, JSON values, grouping helpers."""
