"""Governed analytics over relational tables and files, on the DataFrame API."""
