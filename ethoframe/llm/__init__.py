"""Operators for preparing large text corpora; see README.md for the list."""
