"""Tunables of the engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    sample_size: int = 1000
    first_rows: int = 10_000
    baseline_rows: int = 400
    null_rows: int = 10
    boundary_rows: int = 20
    sample_values: int = 10
    null_spike: float = 0.10
    reconciliation: float = 0.005
    free_text_ratio: float = 0.95
    free_text_distinct: int = 20
    casing_distinct: int = 20
    like_share: float = 0.1
    slash_date_share: float = 0.5
    iso_share: float = 0.8
    intl_share: float = 0.5
    full_resync_rows: int = 10_000
    exception_limit: int = 20
    min_values: int = 10
    concurrency: int = 4
    strict: bool = False  # raise where a step would degrade to a fallback
    mode: str = "full"  # "parity" keeps the historical behaviour of live cleaning


DEFAULTS = Settings()


class FallbackBlocked(RuntimeError):
    """Strict mode refuses a fallback."""


def fallback(settings: Settings, what: str) -> None:
    if settings.strict:
        raise FallbackBlocked(what)
