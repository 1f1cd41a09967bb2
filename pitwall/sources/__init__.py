"""Readers: given tables, derived canonical views, topic frames and wire decoders."""
