"""Treeline operators."""
