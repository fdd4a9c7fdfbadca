"""Continuous drift checks."""
