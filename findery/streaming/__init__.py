"""Continuous indexing of arriving pages."""
