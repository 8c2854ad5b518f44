"""Incremental runs with durable state."""
