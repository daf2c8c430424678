"""Analytics over the whole history of a build farm, as Spark DataFrames."""

__version__ = "0.1.0"
