"""Imports every plan module so that the registry is complete."""

from importlib import import_module

from tickloom.plans.registry import QUERIES

for _name in ("market", "calendars", "trading", "options", "analysis", "quality", "streams", "files"):
    try:
        import_module(f"tickloom.plans.{_name}")
    except ModuleNotFoundError as err:
        if err.name != f"tickloom.plans.{_name}":
            raise

__all__ = ["QUERIES"]
