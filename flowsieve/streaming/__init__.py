"""Scoring of fresh logs with Structured Streaming."""
