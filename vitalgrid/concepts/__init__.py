"""Derived clinical tables: definitions as data on top of the generic operators."""
