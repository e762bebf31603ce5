"""Operators for preparing training data: similarity joins, decontamination, search, mixing, archives."""
