"""Structured Streaming entry points (refresh on arrival of a new sheet export)."""
