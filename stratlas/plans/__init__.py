"""Queries on the driver's tables, and the atlas facade."""
