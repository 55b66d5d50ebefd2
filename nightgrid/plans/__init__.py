"""Registered queries over the driver tables."""

import importlib

_MODULES = ("catalog_queries", "search_queries", "flagship", "radiance_queries", "terrain_queries", "weather_queries", "sky_queries", "object_queries")


def load_all() -> None:
    for name in _MODULES:
        importlib.import_module(f"nightgrid.plans.{name}")
