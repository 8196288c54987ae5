"""Relational, sequence, statistical and audit operators."""
