"""Registered queries; importing this package fills the registry."""
from weftline.plans import (  # noqa: F401
    aggregation, files, joins, parsing, preparation, projection, reshaping, rows, scalars, sqltext, usercode,
)
from weftline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
