"""Operators for preparing training data; nothing else in the library imports this package."""

from importlib import import_module

MODULES = (
    "substring_dedup",
    "jaccard_join",
    "toxicity",
    "quality_rules",
    "mixing",
    "ann",
    "brown_lm",
    "license_scan",
    "piece_codec",
    "url_filter",
)


def queries() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict:
    found = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").SQL
    return found
