"""Every registered query of the engine with its SQL oracle."""

from __future__ import annotations

from tessera.plans import bundles, checks, corpus, evaluation, files, ingest, lanes, mixing, records, telemetry  # noqa: F401 - they register
from tessera.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
