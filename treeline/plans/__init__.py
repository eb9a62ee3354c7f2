"""Treeline plans."""
