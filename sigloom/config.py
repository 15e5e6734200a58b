"""Feed settings."""

from __future__ import annotations

from dataclasses import dataclass

# Exchange numbers, the pattern names and timeframes of the high-score feed, and the
# constant parameters its records carry.
FIRST_EXCHANGE = 1
SECOND_EXCHANGE = 2
PERPETUAL_CONTRACT = 1
HIGH_SCORE_PATTERNS = ("SQUEEZE_IGNITION", "OI_EXPLOSION")
HIGH_SCORE_TIMEFRAMES = ("15m", "1h", "4h")
HIGH_SCORE_PARAMETERS = {
    "recommended_action": "BUY",
    "score_week_filter": 100,
    "score_month_filter": 100,
    "max_trades_filter": 100,
    "stop_loss_filter": 4.0,
    "trailing_activation_filter": 48.0,
    "trailing_distance_filter": 1.0,
}


def enabled_exchanges(first: bool = True, second: bool = True) -> tuple[int, ...]:
    """Exchange numbers for the two switches; at least one has to be on."""
    chosen = tuple(
        number
        for number, on in ((FIRST_EXCHANGE, first), (SECOND_EXCHANGE, second))
        if on
    )
    if not chosen:
        raise ValueError("at least one exchange must be enabled")
    return chosen


@dataclass(frozen=True)
class FeedConfig:
    """Settings of one feed; the defaults are those of the standard feed."""

    window_minutes: int = 32
    exchanges: tuple[int, ...] = (FIRST_EXCHANGE, SECOND_EXCHANGE)
    score_threshold: float = 50.0
    total_score_threshold: float = 250.0
    min_strategy_pnl: float = 180.0
    min_patterns: int = 2
    quiet_hours: tuple[int, int] = (0, 1)
    near_best_share: float = 0.95

    def __post_init__(self) -> None:
        if self.window_minutes <= 0:
            raise ValueError("window_minutes must be positive")
        if not self.exchanges:
            raise ValueError("at least one exchange must be enabled")


STANDARD = FeedConfig()
HIGH_SCORE = FeedConfig()
OPTIMIZED = FeedConfig(window_minutes=30)
BEST_SIGNALS = FeedConfig(window_minutes=2880)
LEGACY = FeedConfig(score_threshold=55.0)
