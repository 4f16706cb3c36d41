"""Operators over property graphs, reports and relational records."""
