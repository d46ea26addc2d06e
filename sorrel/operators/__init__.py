"""Relational operators over graph and reference tables."""
