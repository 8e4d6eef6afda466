"""Relational patterns that the plans share."""
