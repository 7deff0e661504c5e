"""Operators over vault tables."""
