"""Streaming counterparts (extensions; the batch operators are the reference point)."""
