"""Settings of one audit, as an immutable value passed to every operator that needs it."""

from __future__ import annotations

from dataclasses import dataclass

# Names, weights, thresholds and note texts that results are compared on.
REGIONS = ("United States", "Global")
WORLD_REGION = "Global"
BASE_FEATURES = ("streams", "pct_change", "spike_ratio", "seasonal_spike", "rolling_cv")
LOOKAHEAD_FEATURE = "drop_after_spike"
COLLAB_PATTERN = r",\s*|\s*&\s*|\s*ft\.?\s*|\s*feat\.?\s*"
# The same separators, but the words only count when they stand alone.
COLLAB_PATTERN_STRICT = r",\s*|\s*&\s*|\s+ft\.?\s+|\s+feat\.?\s+"
HOLIDAY_ARTISTS = (
    "Brenda Lee", "Bing Crosby", "Bobby Helms", "Perry Como", "Nat King Cole",
    "Andy Williams", "Burl Ives", "Dean Martin", "Mariah Carey",
    "Vince Guaraldi Trio", "Frank Sinatra", "Darlene Love", "The Ronettes",
    "José Feliciano", "Gene Autry", "Carpenters", "Ella Fitzgerald",
    "Tony Bennett", "Chris Rea",
)
DEATH_SPIKE_ARTISTS = (
    "Nipsey Hussle", "Mac Miller", "Juice WRLD", "Pop Smoke", "Lil Peep", "XXXTentacion",
)
DEATH_SPIKE_NOTE = "⚠️ Death/tribute spike detected — results may be inflated"
HOLIDAY_NOTE = "🎄 Holiday-seasonal spike — likely legitimate, not fraud"
RELEASE_NOTE = "🚀 Release-window ramp — likely legitimate launch, not fraud"
ONEOFF_NOTE = "⚡ One-off event spike (viral/sync/tribute) — likely legitimate, not fraud"
MASK_PREFIX = "🔒 Under review #"
NO_REASON = "—"
REASONS = (
    ("r_velocity_spike", "velocity_spike"),
    ("r_seasonal_spike", "seasonal_spike"),
    ("r_plateau", "plateau_low_variance"),
    ("r_drop_after_spike", "drop_after_spike"),
)
REPORT_CAVEAT = "Chart data 2017-2021 vs purges ~2025; directional only."

MODES = ("retrospective", "live")


def features_for(mode: str) -> list[str]:
    """Model features of a mode, in their fixed order."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, not {mode!r}")
    extra = [LOOKAHEAD_FEATURE] if mode == "retrospective" else []
    return [*BASE_FEATURES, *extra]


@dataclass(frozen=True)
class AuditConfig:
    """All tunables. ``replace(cfg, contamination=0.05)`` gives a variant."""

    regions: tuple[str, ...] = REGIONS
    rolling_rows: int = 7
    std_min_rows: int = 3

    contamination: float = 0.02
    seed: int = 42
    trees: int = 200
    tree_sample: int = 256
    neighbors: int = 20

    spike_flag: float = 2.0
    seasonal_flag: float = 2.0
    low_cv: float = 0.15

    weight_flagged: float = 40.0
    weight_spike: float = 30.0
    weight_drop: float = 30.0
    spike_cap: float = 10.0

    min_days: int = 90
    min_streams: float = 5_000_000.0
    min_years: int = 2

    holiday_artists: tuple[str, ...] = HOLIDAY_ARTISTS
    holiday_months: tuple[int, ...] = (11, 12)
    holiday_share: float = 0.6
    holiday_factor: float = 0.3

    death_artists: tuple[str, ...] = DEATH_SPIKE_ARTISTS
    death_factor: float = 0.4

    release_days: int = 14
    release_share: float = 0.6

    oneoff_span_days: int = 45
    oneoff_career_days: int = 365
    oneoff_min_flagged: int = 8
    oneoff_factor: float = 0.2

    collab_pattern: str = COLLAB_PATTERN
    payout_per_stream: float = 0.004

    # One cut per this many rows (on average) when a running total is split over tasks.
    prefix_rows: int = 1 << 18


DEFAULT = AuditConfig()
