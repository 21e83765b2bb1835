"""Structured Streaming scoring with a fitted plan."""
