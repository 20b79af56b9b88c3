"""Structured Streaming versions of panel operators."""
