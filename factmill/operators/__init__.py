"""Relational and graph operators over code facts."""
