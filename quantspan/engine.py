"""From settings to results: routes by kind of run, batches of strategies, and the whole run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.config import Costs
from quantspan.operators import search
from quantspan.operators.signals import flips
from quantspan.operators.strategies import signals
from quantspan.operators.sweep import sweep


@dataclass(frozen=True)
class Settings:
    """What a run does; immutable, made with :meth:`of` from any mapping and changed with :meth:`with_`."""

    costs: Costs = field(default_factory=Costs)
    inside: int = 10_000
    outside: int = 90_000
    lookbacks: tuple[int, ...] = search.LOOKBACKS
    default_lb: int = search.DEFAULT_LB
    metric: str = "sharpe"
    least_trades: int = 10
    most_drawdown: float | None = None
    guard: bool = True
    reward: bool = True
    walk: bool = True
    walk_by: str = "bars"
    walk_step: int = 5000
    regimes: bool = False
    detect: str = "trend"
    labels: tuple[str, ...] = ("Uptrend", "Downtrend", "Ranging")
    scenarios: dict = field(default_factory=dict)
    most_scenarios: int = 5
    strategy: str = "ema_cross"

    @classmethod
    def of(cls, values: dict) -> Settings:
        known = {f.name for f in fields(cls)}
        costs = {f.name for f in fields(Costs)}
        unknown = set(values) - known - costs
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        own = {k: v for k, v in values.items() if k in known}
        return cls(**own).with_(**{k: v for k, v in values.items() if k in costs and k not in known})

    def with_(self, **changes) -> Settings:
        """A copy with changes; names of costs change those."""
        costs = {k: v for k, v in changes.items() if k in {f.name for f in fields(Costs)}}
        own = {k: v for k, v in changes.items() if k not in costs}
        out = replace(self, **own)
        return replace(out, costs=out.costs.with_(**costs)) if costs else out


#: Runs by (by regime, walk forward).
ROUTES: dict[tuple[bool, bool], Callable[[DataFrame, Settings], DataFrame]] = {}


def route(regime: bool, walk: bool) -> Callable:
    """Register a run for a kind of settings."""

    def add(f: Callable[[DataFrame, Settings], DataFrame]) -> Callable:
        ROUTES[regime, walk] = f
        return f

    return add


def dispatch(bars: DataFrame, settings: Settings) -> DataFrame:
    try:
        run = ROUTES[settings.regimes, settings.walk]
    except KeyError:
        raise ValueError(f"no run for regimes={settings.regimes}, walk={settings.walk}") from None
    return run(bars, settings)


@route(regime=False, walk=False)
def single(bars: DataFrame, settings: Settings) -> DataFrame:
    return search.single_run(bars, settings.inside, settings.outside, settings.lookbacks, settings.costs, settings.least_trades)


@route(regime=False, walk=True)
def forward(bars: DataFrame, settings: Settings) -> DataFrame:
    if settings.walk_by == "trades":
        return search.walk_forward_by_trades(bars, settings.inside, settings.walk_step, settings.lookbacks, settings.costs, settings.least_trades, settings.reward)
    return search.walk_forward(bars, settings.inside, settings.walk_step, settings.lookbacks, settings.costs, settings.least_trades, settings.reward)


@route(regime=True, walk=False)
def by_regime(bars: DataFrame, settings: Settings) -> DataFrame:
    """Look-backs by regime, found in sample, and the runs with them in and out of sample."""
    parts = search.segments(bars, settings.inside, settings.outside)
    return search.regime_segments(parts, settings)


@route(regime=True, walk=True)
def forward_by_regime(bars: DataFrame, settings: Settings) -> DataFrame:
    """Windows that follow one another, each with look-backs by regime from its own sample."""
    return search.regime_walk(bars, settings)


def main(bars: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """Every result of a run by name: before and after the search, ratios, the routed run and the scenarios."""
    runs = single(bars, settings)
    out = {"runs": runs, "replication": search.replication(runs)}
    if settings.walk or settings.regimes:
        out["routed"] = dispatch(bars, settings)
    if settings.scenarios:
        out["scenarios"] = search.scenarios(bars, settings.scenarios, settings.default_lb, settings.costs, most=settings.most_scenarios)
    return out


def batch(bars: DataFrame, specs: dict[str, tuple[str, int]], costs: Costs = Costs()) -> DataFrame:
    """Metrics of many strategies, each a name with a registered strategy and a look-back, in one plan keyed by name."""
    columns = ["asset", "bar_idx", "time", "open", "high", "low", "close", "raw"]
    each = [signals(bars, strategy, lb).select(F.lit(name).alias("strategy"), *columns) for name, (strategy, lb) in specs.items()]
    every = flips(reduce(DataFrame.unionByName, each), "strategy", "asset")
    return sweep(every, costs, ("strategy", "asset"))
