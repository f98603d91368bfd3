"""Operators on DataFrames: browsing, edits, exports, migration, keyspaces and statement logs."""
