"""Operators over record tables and matrices."""
