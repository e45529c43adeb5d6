"""Queries over the driver's tables."""

from . import catalogue, kernels, registry, update_queries

__all__ = ["catalogue", "kernels", "registry", "update_queries"]
