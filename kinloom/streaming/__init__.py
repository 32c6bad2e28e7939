"""Structured Streaming counterparts of the live operators."""
