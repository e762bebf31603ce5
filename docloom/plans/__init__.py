"""Registered queries with the equivalent SQL."""
