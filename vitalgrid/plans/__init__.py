"""Dependency-ordered builds and the registry of runnable queries with their SQL counterparts."""
