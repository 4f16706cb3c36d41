"""Readers, and the projection of relational tables to a property graph."""
