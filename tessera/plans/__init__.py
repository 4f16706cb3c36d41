"""Registered queries and the SQL they must equal."""
