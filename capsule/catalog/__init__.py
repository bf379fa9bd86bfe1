"""Registered queries; importing the package registers them all."""

from capsule.catalog import evaluation, items, shopping, suggestions, upkeep  # noqa: F401
from capsule.catalog.registry import QUERIES, Query, Tables  # noqa: F401
