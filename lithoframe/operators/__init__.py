"""Profiling, dataset, comparison, retrieval and operations analytics."""
