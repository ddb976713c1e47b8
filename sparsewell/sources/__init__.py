"""Readers, writers and generators of sparse matrices."""
