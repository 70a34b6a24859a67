"""Readers, payload mappers, lookups and sinks."""
