"""Operators composed of DataFrame transformations."""
