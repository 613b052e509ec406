"""Subpackage: streaming."""
