"""Structured Streaming adapters for fitted, stateless plans."""
