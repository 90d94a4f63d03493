"""Settings shared by every part of the library. Plain values only: nothing here touches Spark."""

from __future__ import annotations

from dataclasses import dataclass, field

STATION = "location_id"
TIME = "timestamp"
MEASURES = ("pm25", "pm10", "co", "no2", "so2", "o3", "aqi")

# The stations the forecasts were defined for, with the numeric code the models were
# trained on and the region code used on the map.
STATIONS = (
    # location_id, location_name, latitude, longitude, location_code, region_iso
    ("hcm", "TP.HCM", 10.8231, 106.6297, 3.0, "VN-SG"),
    ("hanoi", "Hà Nội", 21.0285, 105.8542, 2.0, "VN-HN"),
    ("danang", "Đà Nẵng", 16.0544, 108.2022, 1.0, "VN-DN"),
    ("cantho", "Cần Thơ", 10.0452, 105.7469, 0.0, "VN-CT"),
)

HORIZONS = tuple(range(1, 25))
DISPLAY_ZONE = "Asia/Bangkok"
DISPLAY_FORMAT = "dd/MM/yyyy HH:mm"


@dataclass(frozen=True)
class Chunking:
    """How long series are split so that no station has to fit into one task.

    A station with more rows than ``rows_per_chunk`` is processed as several time chunks. The unit
    grows with the table (total rows / ``max_chunks``), so at most ``max_chunks`` stations are split,
    into a few times as many chunks, and the tables describing them are small enough to broadcast.
    """

    rows_per_chunk: int = 1_000_000
    max_chunks: int = 100_000

    def __post_init__(self):
        if not (self.rows_per_chunk > 0 and 0 < self.max_chunks <= 500_000):
            raise ValueError("rows_per_chunk must be positive and max_chunks at most 500,000")


@dataclass(frozen=True)
class FeatureConfig:
    """Which lags, rolling means and labels to derive, and in what unit.

    ``step="rows"`` counts readings, ``step="hours"`` looks up time offsets and so is immune
    to gaps in the series. The latter wants a regular series, or a tolerance for readings off the hour;
    ``resample_hourly`` makes a regular one of denser readings.
    """

    target: str = "pm25"
    measures: tuple[str, ...] = MEASURES
    lags: tuple[int, ...] = (1, 3)
    means: tuple[int, ...] = (3,)
    step: str = "rows"
    # How far from an exact number of hours a reading may be, in minutes; the nearest one within it counts, the earlier of two.
    tolerance_minutes: float = 0
    station_codes: tuple[tuple[str, float], ...] = tuple((s[0], s[4]) for s in STATIONS)
    # A code no listed station has; None leaves the feature null, so such rows are not complete.
    unknown_code: float | None = -1.0
    chunking: Chunking | None = field(default_factory=Chunking)

    def __post_init__(self):
        if self.step not in ("rows", "hours"):
            raise ValueError(f"step must be 'rows' or 'hours', not {self.step!r}")
        if not 0 <= self.tolerance_minutes < 60 or self.tolerance_minutes and self.step == "rows":
            raise ValueError("a tolerance is less than 60 minutes and for steps in hours")

    @property
    def reach(self) -> int:
        """How far back, in steps, a feature looks."""
        return max(self.lags + self.means, default=0)

    @property
    def derived(self) -> list[str]:
        lags = [f"{self.target}_lag{k}" for k in self.lags]
        means = [f"{self.target}_mean{k}" for k in self.means]
        return lags + means + ["hour", "day_of_week", "location_code"]

    @property
    def features(self) -> list[str]:
        """Model input columns, in the order the vector is assembled."""
        return list(self.measures) + self.derived


def label_name(horizon: int) -> str:
    return f"target_h{horizon}"


@dataclass(frozen=True)
class ForestConfig:
    """Random forest settings. The one-hour model uses ``min_instances=2``, the others 1."""

    # What the published models were trained with.

    trees: int = 20
    depth: int = 10
    bins: int = 32
    min_instances: int = 1
    seed: int = 42


@dataclass(frozen=True)
class SplitConfig:
    """Chronological split: the first ``train`` share of every station's rows, then optionally a
    ``validation`` share, then the test rows. ``purge`` leaves out that many training rows before
    the cut, so that no training label lies in the period that follows."""

    train: float = 0.8
    validation: float = 0.0
    purge: int = 0
