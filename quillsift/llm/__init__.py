"""Operators over message texts and words. Nothing else in the library imports this package."""
