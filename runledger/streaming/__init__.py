"""Continuous intake with Structured Streaming."""
