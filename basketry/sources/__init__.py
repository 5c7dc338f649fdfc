"""Schemas, fixture adapters, file sources and sinks, written intermediate tables."""
