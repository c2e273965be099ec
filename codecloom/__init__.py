"""Token-sequence preparation and evaluation analytics on Spark DataFrames."""

from codecloom.layout import TokenLayout

__all__ = ["TokenLayout"]
