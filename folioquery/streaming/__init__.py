"""Structured Streaming counterparts: an extension of the batch engine."""
