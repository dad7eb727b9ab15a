"""Thresholds of the trip builder, with the defaults of the command line surface."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass

# Fixed values (physical constants and published thresholds).
KNOT_IN_MS = 0.514444
EARTH_RADIUS_NM = 3440.065
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_NM = 1852.0
KELVIN_TO_CELSIUS = 273.15
PA_TO_BAR = 1e-5
KMH_PER_KN = 1.852

# Fixed values (rules of the trip builder that have no command line switch).
ENGINE_IDLE_FUEL_LPH = 0.3
ENGINE_OFF_GAP_S = 60
MAX_INTEGRATION_GAP_S = 3600
RPM_BUCKET = 50
RPM_STABLE_S = 120
CLOCK_RESET_S = 24 * 3600
MAX_PLAUSIBLE_SPEED_KN = 60.0
SOG_CHECK_SLACK_M = 10.0
SOG_CHECK_FACTOR = 3.0
SOG_CHECK_SLACK_MS = 1.5
SOG_CHECK_MAX_DT_S = 30.0
POWER_ON_GAP_S = 300
POWER_ON_SETTLE_S = 300
STRETCH_GAP_S = 30
NO_FIX_HDOP = 50.0
MAX_TRACK_POINTS = 500
FILES_PER_FOLDER = 100

US = 1_000_000  # microseconds per second; all times are BIGINT microseconds since 1970 (UTC)

# Raised whenever a rule change could alter an already settled trip.
TRIP_LOGIC_VERSION = 1


@dataclass(frozen=True)
class TripParams:
    speed_threshold_kn: float = 0.5
    min_stop_minutes: float = 10.0
    max_gap_minutes: float | None = None
    min_trip_distance_nm: float = 0.1
    min_leg_distance_nm: float | None = 0.2
    lock_radius_m: float | None = 10.0
    lock_max_duration_minutes: float | None = 120.0
    battery_warning_voltage: float = 12.2
    log_interval_minutes: float = 30.0
    utc_offset_hours: float | None = None
    engine_count: int | None = None
    chunk_hours: float = 6.0  # time slice that one task sorts; see operators/scan.py

    @property
    def speed_threshold_ms(self) -> float:
        return self.speed_threshold_kn * KNOT_IN_MS

    @property
    def min_stop_us(self) -> int:
        return int(self.min_stop_minutes * 60 * US)

    @property
    def max_gap_us(self) -> int:
        minutes = self.min_stop_minutes if self.max_gap_minutes is None else self.max_gap_minutes
        return int(minutes * 60 * US)

    @property
    def min_leg_nm(self) -> float:
        return self.min_trip_distance_nm if self.min_leg_distance_nm is None else self.min_leg_distance_nm

    @property
    def confine_radius_m(self) -> float | None:
        """The lock radius; a negative one switches the rule off, like None."""
        return None if self.lock_radius_m is None or self.lock_radius_m < 0 else self.lock_radius_m

    @property
    def locks_on(self) -> bool:
        return self.confine_radius_m is not None and self.lock_max_duration_minutes is not None

    @property
    def lock_max_us(self) -> int:
        return int((self.lock_max_duration_minutes or 0) * 60 * US)

    @property
    def chunk_us(self) -> int:
        return int(self.chunk_hours * 3600 * US)

    def signature(self) -> str:
        """Hash of everything that changes a settled trip; stored next to settled trips. How rows are cut
        into slices changes none."""
        parts = asdict(self) | {"trip_logic_version": TRIP_LOGIC_VERSION}
        del parts["chunk_hours"]
        return hashlib.sha1("|".join(f"{k}={parts[k]!r}" for k in sorted(parts)).encode()).hexdigest()
