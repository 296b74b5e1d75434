"""runlens: analytics over fleets of machine-learning training runs, on Spark DataFrames."""

from runlens.session import build_session

__all__ = ["build_session"]
