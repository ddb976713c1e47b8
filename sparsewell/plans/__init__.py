"""Iterative solvers as driver loops over lazily built plans."""
