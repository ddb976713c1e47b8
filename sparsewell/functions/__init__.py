"""Scalar column functions of the packed layouts."""
