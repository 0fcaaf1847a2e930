"""Docketry functions."""
