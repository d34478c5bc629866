"""Relational operators over canonical events."""
