"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it. ``queries`` registers one query per
operator; each operator module has its own general interface.
"""
