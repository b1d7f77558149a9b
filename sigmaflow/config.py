"""Job parameters (the one-row parameter table of the original pipeline).

A frozen dataclass: values become literals inside Spark expressions, so
Catalyst can fold them and push range predicates into the parquet scan.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from zoneinfo import ZoneInfo

# Labels, thresholds and constants that results depend on.
DISTRIBUTIONS = ("Normal", "Student-t")
FORECAST_STYLES = ("5min", "daily", "5min_no_outlier", "5min_filtered")
OUTLIER_SD_MULTIPLIER = 5.0
BARS_PER_DAY = 288
BAR_INTERVAL = "5 minutes"
MAX_PERSISTENCE = 0.999
NU_BOUNDS = (2.1, 100.0)
ACF_BAND_Z = 1.959963984540054  # standard normal 97.5% quantile
EPOCH = dt.datetime(1970, 1, 1)


@dataclass(frozen=True)
class Params:
    """Analysis range and forecast origin: wall clock of ``tz``, whose calendar days are the days of the analysis.

    Timestamps of tables are naive UTC; ``utc`` gives what a wall-clock time is there.
    """

    tz: str = "UTC"
    start: dt.datetime = dt.datetime(2024, 1, 1, 0, 0, 0)
    end: dt.datetime = dt.datetime(2024, 1, 29, 23, 59, 59)
    forecast_start: dt.datetime = dt.datetime(2024, 1, 20, 23, 55, 0)
    # day dropped from the evaluation to build the "no outlier" variant
    excluded_day: dt.date | None = dt.date(2024, 1, 25)

    def utc(self, value: dt.datetime) -> dt.datetime:
        """Naive UTC of a wall-clock time of the zone (the first of two equal ones, where a clock is set back)."""
        return value.replace(tzinfo=ZoneInfo(self.tz)).astimezone(dt.timezone.utc).replace(tzinfo=None)

    @property
    def origin_day(self) -> dt.date:
        """Last in-sample day; forecasts are made for every later day."""
        return self.forecast_start.date()


# Parameters for the tick tables (``events``) and the daily tables (``orders``).
TICK_PARAMS = Params()
DAILY_PARAMS = Params(
    start=dt.datetime(1995, 1, 1, 0, 0, 0),
    end=dt.datetime(2001, 8, 1, 23, 59, 59),
    forecast_start=dt.datetime(2001, 6, 30, 23, 55, 0),
    excluded_day=None,
)


@dataclass(frozen=True)
class GarchGrid:
    """Candidate parameters for the grid QMLE: alpha, persistence = alpha + beta, nu."""

    alphas: tuple[float, ...] = (0.02, 0.05, 0.08, 0.12, 0.16, 0.22)
    persistences: tuple[float, ...] = (0.90, 0.95, 0.98, 0.99, MAX_PERSISTENCE)
    nus: tuple[float, ...] = (3.0, 4.0, 6.0, 10.0, 30.0)

    def points(self, distribution: str) -> list[tuple[float, float, float | None]]:
        nus = self.nus if distribution == "Student-t" else (None,)
        return [(a, p, n) for a in self.alphas for p in self.persistences if a <= p for n in nus]


DEFAULT_GRID = GarchGrid()
#: Coarse candidates over the whole range; the refined fit climbs from each that none of its neighbours exceeds.
GUARD_GRID = GarchGrid(alphas=(0.0, 0.05, 0.22, 0.5, 0.8), persistences=(0.90, 0.98, MAX_PERSISTENCE), nus=(3.0, 6.0, 100.0))


@dataclass(frozen=True)
class ScaleKnobs:
    """Physical knobs; none of them changes a result."""

    # rows per chunk when a long series is split for sequential operators (ACF)
    chunk_rows: int = 20_000
    # exact median: histogram buckets per refinement pass, and the most values
    # a series may still have in its bracket before the final exact ranking
    median_buckets: int = 4096
    median_max_candidates: int = 1_000_000
    # write shared intermediates (returns tables) to the checkpoint folder once per plan
    materialize: bool = True


DEFAULT_KNOBS = ScaleKnobs()
