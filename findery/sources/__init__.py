"""Readers of query, judgment and run files, of web pages, and views of given tables."""
