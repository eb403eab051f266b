"""Event-log analytics on Spark DataFrames."""

from caseloom.session import prepare

__all__ = ["prepare"]
