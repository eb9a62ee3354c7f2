"""Treeline sources."""
