"""Parameters and errors."""

from __future__ import annotations

from dataclasses import dataclass

PRICE_COLUMNS = ("open", "high", "low", "close", "volume")
PERIODS = ("2y", "5y", "10y", "max")
TRADING_DAYS, HORIZON_DAYS, MOVE_TOLERANCE_PCT = 252, 90, 0.06


class EngineError(Exception):
    """Base of this library's errors."""


class FetchError(EngineError):
    """A source gave nothing."""


class InvalidHistoryError(EngineError):
    """A price history can't be used."""


class JournalError(EngineError):
    """A journal doesn't belong to the run that resumes it."""


class GroundingError(EngineError):
    """A report claims what its evidence doesn't hold."""


class ProviderError(EngineError):
    """A completion or search provider failed."""

    def __init__(self, message: str, category: str = "connection", retry_after: float | None = None):
        super().__init__(message)
        self.category, self.retry_after = category, retry_after


@dataclass(frozen=True)
class IndicatorConfig:
    sma_short: int = 50
    sma_long: int = 200
    rsi_period: int = 14
    macd_fast: int = 12
    macd_slow: int = 26
    macd_signal: int = 9
    band_window: int = 20
    band_width: float = 2.0

    def __post_init__(self):
        for name, value in vars(self).items():
            kind, least = (float, 0.0) if name == "band_width" else (int, 1)
            if isinstance(value, bool) or not isinstance(value, (int, kind)) or not value >= least or value == 0:
                raise ValueError(f"{name} must be a {kind.__name__} above 0")
        if self.macd_fast >= self.macd_slow:
            raise ValueError("macd_fast must be below macd_slow")


@dataclass(frozen=True)
class PipelineConfig:
    ticker: str = "NVDA"
    period: str = "2y"
    headline_count: int = 10
    timeout: float = 20.0

    def __post_init__(self):
        if not self.ticker.strip() or self.period not in PERIODS or self.headline_count < 10 or self.timeout <= 0:
            raise ValueError("ticker, a known period, at least 10 headlines and a positive timeout are needed")


@dataclass(frozen=True)
class GenerationConfig:
    candidates: int = 160
    batch_size: int = 5
    minimum: int = 120
    target: int = 130
    seed: int = 42

    def __post_init__(self):
        if not 120 <= self.candidates <= 1000 or not 5 <= self.batch_size <= 20 or not self.minimum <= self.target <= self.candidates:
            raise ValueError("120 to 1000 candidates, batches of 5 to 20, minimum <= target <= candidates")
