"""Subpackage of folioflow."""
