"""Parameters of one anchored-window extraction. Every duration is microseconds, the unit of the `us` column."""

from __future__ import annotations

from dataclasses import dataclass, field

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR

# fixed values: default lag per sensor channel, minutes
NATIVE_INTERVAL_MINUTES = {"sensor_a": 5, "sensor_b": 15}


@dataclass(frozen=True)
class WindowSpec:
    channel: str = "sensor_a"
    window: int = 120 * MINUTE
    max_gap: int = 15 * MINUTE
    trailing: int = 5 * MINUTE
    lag: int | None = None
    extra_age: int = 15 * MINUTE
    overlap: int | None = None
    unit: int = MINUTE
    trend: int = 30 * MINUTE
    trend_min_points: int = 3
    activity: tuple[int, int, int] = (4 * HOUR, 1 * HOUR, 24 * HOUR)
    activity_rate: float = 60.0 / HOUR
    min_activity_coverage: float = 0.5
    threshold: float = 180.0
    require_isolated: bool = True
    chunk: int | None = None
    on_duplicates: str = "keep_first"
    roles: tuple = field(default=(), compare=False)

    @property
    def lag_us(self) -> int:
        if self.lag is not None:
            return self.lag
        return NATIVE_INTERVAL_MINUTES.get(self.channel, 0) * MINUTE

    @property
    def overlap_us(self) -> int:
        return self.window if self.overlap is None else self.overlap

    @property
    def lookback(self) -> int:
        return max(self.lag_us + self.extra_age, self.lag_us + self.trend, *self.activity)

    @property
    def chunk_us(self) -> int:
        """Width of the time slices a participant is split into: wide enough that the copied edges stay a minority."""
        return self.chunk or 4 * (self.lookback + self.window)


# the sparse hourly fixture: one hour plays the role of one minute
FIXTURE = WindowSpec(
    window=120 * HOUR, max_gap=48 * HOUR, trailing=48 * HOUR, lag=12 * HOUR, extra_age=48 * HOUR, overlap=24 * HOUR,
    unit=HOUR, trend=72 * HOUR, activity=(240 * HOUR, 60 * HOUR, 480 * HOUR), activity_rate=0.02 / HOUR, threshold=100.0,
)

OUTCOME_WINDOW = 120 * MINUTE
THRESHOLD = 180.0
LABEL_TOLERANCE = 1e-6
Z90 = 1.6448536269514722
COLD_START_MAX = 3
EXPERIENCED_MIN = 10
LOW_ACTIVITY_COVERAGE = 0.5
STALE_BASELINE = 30.0
