"""Queries by name; importing the package registers all of them."""
