"""Operators for cleaning and scoring large text corpora; nothing else in the library imports this package."""
