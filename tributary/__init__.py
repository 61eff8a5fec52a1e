"""Recommendation and usage analytics on Spark."""
