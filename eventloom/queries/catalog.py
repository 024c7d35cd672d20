"""All registered queries of the telemetry operators."""

from . import annotate, answers, ingest, live, parts, reports, scalars, scene, sessions, streaming, timeseries  # noqa: F401
from .shapes import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
