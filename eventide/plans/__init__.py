"""Registered queries over the given tables, by section of the operator inventory."""
