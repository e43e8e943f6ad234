"""Structured Streaming forms of the temporal operators, and incremental upkeep of programs."""
