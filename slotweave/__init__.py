"""Hourly activation analytics and next-day prediction on Spark."""
