"""Streaming of the recommendation engine."""
