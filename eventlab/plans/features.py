"""Whole feature tables from panels, metadata and events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..operators.events import event_join, standardised_surprise
from ..operators.labels import label_spike, triple_barrier
from ..operators.panel import attach_sector_rank, forward_returns, latest_snapshot, momentum, sector_join, sector_ranks
from ..schemas import LABEL, target
from ..storage import stored


def _check_windows(windows: Sequence[int], rank_window: int, required: Sequence[int]) -> None:
    missing = {rank_window, *required} - set(windows)
    if missing:
        raise ValueError(f"momentum windows lack {sorted(missing)}")


def event_features(
    prices: DataFrame,
    metadata: DataFrame,
    earnings: DataFrame,
    *,
    windows: Sequence[int] = (14, 60),
    rank_window: int = 60,
    horizon: int = 1,
    threshold: float = 0.02,
    label_price: str = "high",
    barrier: dict | None = None,
    with_sue: bool = False,
    sue_window: int = 8,
    sue_min_periods: int = 4,
) -> DataFrame:
    """One row per announcement day: momentum, sector rank, surprise, outcome and label.

    Momentum, outcomes and label share one window per symbol. Events come after it, as a
    row's neighbours are trading days, not event days. The panel is ranked in a narrow
    branch of its own, and only event rows meet the ranks.

    ``barrier`` (options of `triple_barrier`) replaces the threshold label.
    """
    _check_windows(windows, rank_window, (14,))
    moved = momentum(sector_join(prices, metadata), windows)
    ahead = forward_returns(moved, horizon)
    if barrier is None:
        labelled = label_spike(ahead, threshold, horizon, label_price)
    else:
        labelled = triple_barrier(ahead, **barrier)
    events = event_join(labelled, earnings)
    extra = []
    if with_sue:
        events, extra = standardised_surprise(events, sue_window, sue_min_periods), ["sue"]
    rank_return = f"return_{rank_window}d"
    events = events.na.drop(subset=[rank_return, target(horizon, "high")])
    ranked = attach_sector_rank(events, sector_ranks(moved, rank_window), rank_window, "inner")
    return _shown(ranked, horizon, rank_window, extra)


def event_features_each(
    prices: DataFrame,
    metadata: DataFrame,
    earnings: DataFrame,
    labels: Sequence[tuple[int, str]],
    *,
    windows: Sequence[int] = (14, 60),
    rank_window: int = 60,
    threshold: float = 0.02,
) -> list[DataFrame]:
    """`event_features` for several (horizon, label price), over one pass of the panel.

    The event rows with the outcomes of all horizons are stored; labels follow from them row by row.
    """
    _check_windows(windows, rank_window, (14,))
    moved = momentum(sector_join(prices, metadata), windows)
    ahead = moved
    for horizon in sorted({h for h, _ in labels}):
        ahead = forward_returns(ahead, horizon)
    events = event_join(ahead, earnings).na.drop(subset=[f"return_{rank_window}d"])
    ranked = stored(attach_sector_rank(events, sector_ranks(moved, rank_window), rank_window, "inner"), "events")
    labelled = [label_spike(ranked.na.drop(subset=[target(h, "high")]), threshold, h, price) for h, price in labels]
    return [_shown(rows, h, rank_window) for rows, (h, _) in zip(labelled, labels, strict=True)]


def _shown(ranked: DataFrame, horizon: int, rank_window: int, extra: Sequence[str] = ()) -> DataFrame:
    rank_return = f"return_{rank_window}d"
    return ranked.select(
        "date",
        "symbol",
        "sector",
        "close",
        "volume",
        "eps_estimate",
        "reported_eps",
        "surprise_pct",
        *extra,
        "return_14d",
        *([rank_return] if rank_window != 14 else []),
        f"sector_rank_{rank_window}d",
        *[target(horizon, p) for p in ("open", "high", "low", "close")],
        LABEL,
    )


def price_snapshot(
    prices: DataFrame, metadata: DataFrame, *, windows: Sequence[int] = (14, 60), rank_window: int = 60
) -> DataFrame:
    """The latest features of every symbol, whether or not it has an event.

    The last values are taken before the ranks are attached, so ranks are joined to one
    row per symbol; a row with a return always has a rank on its own day.
    """
    _check_windows(windows, rank_window, ())
    moved = momentum(sector_join(prices, metadata), windows)
    latest = latest_snapshot(moved, rank_window)
    return attach_sector_rank(latest, sector_ranks(moved, rank_window), rank_window, "inner")
