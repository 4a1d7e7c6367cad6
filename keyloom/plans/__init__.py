"""Queries over the driver's tables, one module for each family of operators."""

from importlib import import_module

FAMILIES = ["timeseries", "zsets", "sets", "hashes", "keyspace", "lists", "streams", "geo", "vectors", "jsondoc", "sketches", "misc"]


def load() -> None:
    for family in FAMILIES:
        import_module(f"{__name__}.{family}")
