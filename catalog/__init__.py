"""Every operator as a query over the driver's tables, with its SQL twin."""

from catalog import inference, ingest, jobs, labels, models, sources, stats, streams, text, urls  # noqa: F401
from catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
