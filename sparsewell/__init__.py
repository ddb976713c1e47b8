"""Sparse linear algebra and iterative solvers as Spark DataFrame jobs."""
