"""tickloom - futures and options market-data analytics on PySpark."""

from tickloom.session import build_session

__all__ = ["build_session"]
