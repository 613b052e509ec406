"""Subpackage: plans."""
