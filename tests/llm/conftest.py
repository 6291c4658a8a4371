"""These tests share the session of ``tests/conftest.py``."""
