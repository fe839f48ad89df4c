"""Sparse linear algebra and graph analytics on Spark DataFrames."""

from .matrix import Matrix
from .operators import direct, elementwise, gradients, graph, krylov, nonlinear, partition, predicates, products, reductions, reshape, spectral

__all__ = ["Matrix", "direct", "elementwise", "gradients", "graph", "krylov", "nonlinear", "partition", "predicates", "products", "reductions", "reshape", "spectral"]
