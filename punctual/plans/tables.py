"""The source tables an analysis runs on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    """Observations and the optional companions; an absent one gives empty results."""

    observations: DataFrame
    polls: DataFrame | None = None
    alerts: DataFrame | None = None
    stops: DataFrame | None = None
    routes: DataFrame | None = None
    city_parts: DataFrame | None = None
