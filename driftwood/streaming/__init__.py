"""Structured Streaming forms of drift monitoring and scoring."""
