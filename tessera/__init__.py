"""Release-catalogue, byte-range and binary-image analytics on Spark DataFrames."""

from .session import ship

__all__ = ["ship"]
