"""Batch jobs and the registered queries."""
