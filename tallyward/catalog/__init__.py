"""Registered queries over the star-schema test tables, each with its SQL twin where one exists."""

from importlib import import_module

MODULES = ["features", "sequence", "graph", "campaign", "evaluation", "decisions", "detectors", "streams"]


def load_all():
    from tallyward.catalog.registry import ORACLES, QUERIES

    for module in MODULES:
        import_module(f"tallyward.catalog.{module}")
    return dict(QUERIES), dict(ORACLES)
