"""Operators over game tables and models."""
