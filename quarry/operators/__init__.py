"""Relational operators: intake, RAW snapshots, profiling, entities, ledger,
tenancy, table verbs and integrity checks."""
