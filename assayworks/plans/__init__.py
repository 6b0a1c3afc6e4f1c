"""Whole runs: assured pipelines and their training jobs."""
