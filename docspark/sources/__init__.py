"""Readers and byte decoders."""
