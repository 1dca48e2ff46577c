"""The search for a look-back and a reward, walk-forward and single runs, robustness scenarios and regime runs."""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantspan.config import SCENARIO_FLAGS, Costs
from quantspan.functions.ewm import span, with_ewm
from quantspan.functions.windows import lag, w
from quantspan.operators.regimes import DETECTORS
from quantspan.operators.signals import drifted, flips
from quantspan.operators.simulate import metrics, simulate
from quantspan.operators.sweep import best_reward, crosses, excursions, sweep, windows, with_idle
from quantspan.sources.scratch import written

DEFAULT_LB, FAST = 50, 20
LOOKBACKS = tuple(range(12, 76))


def rewarded(signals: DataFrame, bars: DataFrame, costs: Costs = Costs(), keys: tuple[str, ...] = ("asset", "lb"), most: int = 3) -> DataFrame:
    """The signals with ``rrr``: the target, in stops, that would have earned most in a probe with a target of five."""
    probe = simulate(signals, costs.with_(target_pct=5 * costs.stop_pct, use_target=True), keys)
    best = best_reward(excursions(probe, bars, costs.stop_pct, keys), most, keys).select(*keys, "rrr")
    return signals.join(best, list(keys), "left").withColumn("rrr", F.coalesce("rrr", F.lit(1)))


def searched(signals: DataFrame, bars: DataFrame, costs: Costs = Costs(), keys: tuple[str, ...] = ("asset", "lb"), reward: bool = True) -> DataFrame:
    """Metrics and ``rrr`` of every candidate, each run with its own best target."""
    if not reward:
        return sweep(signals, costs, keys).withColumn("rrr", F.lit(None).cast("int"))
    with_targets = rewarded(signals, bars, costs, keys)
    own = costs.with_(use_target=True)
    results = metrics(simulate(with_targets, own, keys, target=F.col("rrr") * costs.stop_pct), own, keys)
    return with_idle(results, with_targets.select(*keys, "rrr").distinct(), keys)


def ranked(results: DataFrame, metric: str = "sharpe", least_trades: int = 10, keys: tuple[str, ...] = ("asset",), most_drawdown: float | None = None) -> DataFrame:
    """Candidates of a coarse search over every second look-back and of the look-backs beside its best, by ``rank``.

    All look-backs are there already, so coarse and fine are filters. Of equals the coarse one is first, then
    the smaller one.
    """
    value = -F.col(metric) if metric == "max_drawdown" else F.col(metric)
    usable = (F.col("trades") >= least_trades) & (F.lit(True) if most_drawdown is None else F.col("max_drawdown") <= most_drawdown)
    order = Window.partitionBy(*keys).orderBy("lb")
    placed = results.withColumn("place", F.row_number().over(order) - 1).withColumn("value", F.when(usable, F.round(value, 9)))
    placed = placed.withColumn("pf_below", F.lag(F.when(usable, F.col("pf"))).over(order)).withColumn("pf_above", F.lead(F.when(usable, F.col("pf"))).over(order))
    placed = placed.where("value is not null")
    best = placed.where("place % 2 = 0").groupBy(*keys).agg(F.max_by("place", F.struct("value", -F.col("place"))).alias("coarse"))
    near = placed.join(best, list(keys)).where("abs(place - coarse) <= 1")
    first = Window.partitionBy(*keys).orderBy(F.desc("value"), F.abs(F.col("place") - F.col("coarse")), "lb")
    return near.withColumn("rank", F.row_number().over(first))


def smart(candidates: DataFrame, keys: tuple[str, ...] = ("asset",), jump: float = 1.10) -> DataFrame:
    """The first candidate whose profit factor is no spike over a usable look-back beside it; else the best."""
    spike = F.coalesce(F.col("pf") > F.col("pf_below") * jump, F.lit(False)) | F.coalesce(F.col("pf") > F.col("pf_above") * jump, F.lit(False))
    order = Window.partitionBy(*keys).orderBy(spike.cast("int"), "rank")
    return candidates.withColumn("choice", F.row_number().over(order)).where("choice = 1").drop("choice")


def chosen(results: DataFrame, metric: str = "sharpe", least_trades: int = 10, keys: tuple[str, ...] = ("asset",), most_drawdown: float | None = None, guard: bool = True, default_lb: int = DEFAULT_LB) -> DataFrame:
    """``lb, rrr`` of each key; the default look-back where no candidate is usable, so that no key is lost."""
    candidates = ranked(results, metric, least_trades, keys, most_drawdown)
    best = smart(candidates, keys) if guard else candidates.where("rank = 1")
    every = results.select(*keys).distinct().join(best.select(*keys, "lb", "rrr"), list(keys), "left")
    return every.select(*keys, F.coalesce("lb", F.lit(default_lb)).alias("lb"), "rrr", F.col("lb").isNull().alias("fallback"))


def crosses_at(bars: DataFrame, keys: tuple[str, ...], fast: int = FAST) -> DataFrame:
    """Codes of the EMA cross whose slow length is the column ``lb``, one value in each group of ``keys``."""
    schema = T.StructType([*bars.schema.fields, T.StructField("fast", T.DoubleType()), T.StructField("slow", T.DoubleType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        return rows.assign(fast=rows["close"].ewm(span=fast, adjust=False).mean(), slow=rows["close"].ewm(span=int(rows["lb"].iat[0]), adjust=False).mean())

    means = bars.groupBy(*keys).applyInPandas(run, schema)
    raw = F.signum(F.lag("fast").over(w(*keys)) - F.lag("slow").over(w(*keys)))
    return flips(means.withColumn("raw", F.coalesce(raw, F.lit(0.0)).cast("int")), *keys)


def walk_forward(bars: DataFrame, in_bars: int, out_bars: int, lookbacks: tuple[int, ...] = LOOKBACKS, costs: Costs = Costs(), least_trades: int = 10, reward: bool = True) -> DataFrame:
    """Out-of-sample trades of the look-back chosen in each window's sample; means are seeded anew in each part.

    Every look-back is run in sample, only the chosen one out of sample, and there with the usual target.
    """
    parts = windows(bars, in_bars, out_bars)
    keys = ("asset", "window_no")
    inside = parts.where("sample = 'IS'").drop("sample")
    results = searched(crosses(inside, list(lookbacks), keys), inside, costs, (*keys, "lb"), reward)
    best = chosen(results, least_trades=least_trades, keys=keys).select(*keys, "lb")
    outside = parts.where("sample = 'OOS'").drop("sample").join(best, list(keys))
    return simulate(crosses_at(outside, (*keys, "lb")), costs, (*keys, "lb"))


def walk_forward_by_trades(bars: DataFrame, in_bars: int, trades: int, lookbacks: tuple[int, ...] = LOOKBACKS, costs: Costs = Costs(), least_trades: int = 10, reward: bool = True) -> DataFrame:
    """As :func:`walk_forward`, but a window ends with the bar on which its trade number ``trades`` ends.

    Where a window starts depends on the one before, so windows are a loop on the driver; each step runs all
    assets that have bars left, and its state is one row an asset, in a written table.
    """
    sizes = written(bars.groupBy("asset").agg((F.max("bar_idx") + 1).alias("n")).where(F.col("n") > in_bars).withColumn("start", F.lit(in_bars).cast("long")))
    done: list[DataFrame] = []
    number = 0
    while not (state := sizes.where("start < n")).isEmpty():
        rows = bars.select("asset", "bar_idx", "time", "open", "high", "low", "close").join(state, "asset")
        inside = rows.where(F.col("bar_idx").between(F.col("start") - in_bars, F.col("start") - 1)).withColumn("bar_idx", F.col("bar_idx") - F.col("start") + in_bars).drop("start", "n")
        best = written(chosen(searched(crosses(inside, list(lookbacks)), inside, costs, ("asset", "lb"), reward), least_trades=least_trades).select("asset", "lb"))
        rest = rows.where("bar_idx >= start").withColumn("bar_idx", F.col("bar_idx") - F.col("start")).join(best, "asset")
        probe = simulate(crosses_at(rest.drop("start", "n"), ("asset", "lb")), costs, ("asset", "lb"))
        place = F.row_number().over(Window.partitionBy("asset").orderBy("trade_group_id"))
        last = probe.withColumn("place", place).where(F.col("place") <= trades).groupBy("asset").agg(F.max_by("exit_idx", "place").alias("exit_idx"))
        ends = state.join(last, "asset", "left").join(best, "asset")
        ends = written(ends.select("asset", "n", "lb", "start", F.least("n", F.coalesce(F.col("start") + F.col("exit_idx") + 1, F.col("n"))).alias("stop")))
        window = rows.drop("start", "n").join(ends, "asset").where("bar_idx >= start and bar_idx < stop").withColumn("bar_idx", F.col("bar_idx") - F.col("start")).drop("n", "start", "stop")
        made = simulate(crosses_at(window, ("asset", "lb")), costs, ("asset", "lb")).withColumn("window_no", F.lit(number).cast("long"))
        done.append(written(made.join(ends.select("asset", F.col("start").alias("window_start"), F.col("stop").alias("window_stop")), "asset")))
        sizes, number = ends.select("asset", "n", F.col("stop").alias("start")), number + 1
    return reduce(DataFrame.unionByName, done)


def segments(bars: DataFrame, inside: int, outside: int) -> DataFrame:
    """The last bars of each asset as samples IS and OOS, each numbered from 0."""
    n = F.max("bar_idx").over(Window.partitionBy("asset")) + 1
    out = F.col("bar_idx") >= F.col("n") - outside
    rows = bars.withColumn("n", n).where(F.col("bar_idx") >= F.col("n") - inside - outside)
    idx = F.col("bar_idx") - F.col("n") + F.when(out, F.lit(outside)).otherwise(inside + outside)
    return rows.select("asset", F.when(out, "OOS").otherwise("IS").alias("sample"), idx.alias("bar_idx"), "time", "open", "high", "low", "close")


def single_run(bars: DataFrame, inside: int, outside: int, lookbacks: tuple[int, ...] = LOOKBACKS, costs: Costs = Costs(), least_trades: int = 10) -> DataFrame:
    """Metrics in and out of sample before the search (the default look-back) and after it (the chosen look-back and target)."""
    parts = segments(bars, inside, outside)
    keys = ("asset", "sample", "lb")
    before = sweep(crosses_at(parts.withColumn("lb", F.lit(DEFAULT_LB)), keys), costs, keys).withColumn("phase", F.lit("raw")).withColumn("rrr", F.lit(None).cast("int"))
    own = parts.where("sample = 'IS'").drop("sample")
    best = chosen(searched(crosses(own, list(lookbacks)), own, costs), least_trades=least_trades)
    codes = crosses_at(parts.join(best.select("asset", "lb"), "asset"), keys).join(best.select("asset", "rrr"), "asset")
    target = F.coalesce(F.col("rrr") * costs.stop_pct, F.lit(costs.target_pct))
    after = sweep(codes, costs, keys, target=target).join(best.select("asset", "rrr"), "asset").withColumn("phase", F.lit("optimised"))
    return before.unionByName(after)


METRICS = ("roi", "pf", "sharpe", "win_rate", "exp", "max_drawdown", "consistency")


def replication(runs: DataFrame) -> DataFrame:
    """``runs``: asset, phase, sample and metrics -> each metric out of sample over that in sample; null over zero."""
    side = lambda s: [F.max(F.when(F.col("sample") == s, F.col(m))) for m in METRICS]
    ratios = [F.try_divide(o, F.nullif(i, F.lit(0.0))).alias(m) for m, i, o in zip(METRICS, side("IS"), side("OOS"), strict=True)]
    return runs.groupBy("asset", "phase").agg(*ratios)


# --- robustness ------------------------------------------------------------------------------------
def scenario(flags: tuple[str, ...]) -> dict:
    """What a scenario's flags, or their short names, change."""
    tokens = {f.strip().lower().replace(" ", "_") for f in flags}
    on = {name: not tokens.isdisjoint(names) for name, (_, names) in SCENARIO_FLAGS.items()}
    return {"fee_mult": 2.0 if on["fee"] else 1.0, "slip_mult": 3.0 if on["slippage"] else 1.0, "news": on["news"], "late": on["drift"], "varied": on["variance"]}


def scenario_label(flags: tuple[str, ...]) -> str:
    """Three letters for each flag."""
    short = {names[0]: label for label, names in SCENARIO_FLAGS.values()}
    tokens = [f.strip().lower().replace(" ", "_") for f in flags]
    return "+".join(short.get(t, t[:3].upper()) for t in tokens) or "NONE"


def news_candles(bars: DataFrame, seed: int = 0, keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Every 500 to 1000 bars one or two get wicks of two to five mean ranges of the 100 bars before."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx").reset_index(drop=True)
        rng, n, i = random.Random(seed), len(rows), 0
        high, low = rows["high"].to_numpy(copy=True), rows["low"].to_numpy(copy=True)
        both = rows[["open", "close"]].to_numpy()
        while (i := i + rng.randint(500, 1000)) < n:
            burst = rng.randint(1, 2)
            for k in range(i, min(i + burst, n)):
                spread = np.abs(high[max(0, k - 100) : k] - low[max(0, k - 100) : k]).mean()
                if not spread > 0:
                    spread = np.abs(high - low).mean()
                extent, side = spread * rng.uniform(2, 5), rng.choice(["up", "down", "both"])
                top, bottom = max(high[k], both[k].max()), min(low[k], both[k].min())
                high[k] = top + extent * (side in ("up", "both"))
                low[k] = bottom - extent * (side in ("down", "both"))
            i += burst
        return rows.assign(high=high, low=low)

    return bars.groupBy(*keys).applyInPandas(run, bars.schema)


def scenarios(bars: DataFrame, specs: dict[str, tuple[str, ...]], lb: int = DEFAULT_LB, costs: Costs = Costs(), keys: tuple[str, ...] = ("asset",), seed: int = 0, most: int = 5) -> DataFrame:
    """Metrics of the EMA cross under the first ``most`` scenarios beside those as it is. A scenario is data: what
    it changes are columns of one small table, and all run in one plan."""
    offset = random.Random(42).choice([-1, 1])
    named = [("base", scenario(())), *((k, scenario(v)) for k, v in list(specs.items())[:most])]
    table = bars.sparkSession.createDataFrame([(k, o["fee_mult"], o["slip_mult"], o["news"], o["late"], max(1, lb + offset * o["varied"])) for k, o in named], "scenario string, fee_mult double, slip_mult double, news boolean, late boolean, lb int")
    quiet = bars.withColumn("news", F.lit(False))
    every = quiet.unionByName(news_candles(bars, seed, keys).withColumn("news", F.lit(True))) if any(o["news"] for _, o in named) else quiet
    codes = crosses(every, sorted({max(1, lb + offset * o["varied"]) for _, o in named}), (*keys, "news"))
    both = codes.withColumn("late", F.lit(False)).unionByName(drifted(codes, *keys, "news", "lb").withColumn("late", F.lit(True)))
    runs = both.join(F.broadcast(table), ["news", "late", "lb"])  # six rows at most
    own = (*keys, "scenario")
    results = metrics(simulate(runs, costs, own, fee=F.col("fee_mult") * costs.fee, slip=F.col("slip_mult") * costs.slip), costs, own)
    return with_idle(results, runs.select(*own).distinct(), own)


# --- runs by regime --------------------------------------------------------------------------------
def by_regime(rows: DataFrame, lookbacks: tuple[int, ...], chosen_lb: Column) -> Column:
    """The raw signal of a bar: above the mean of the look-back ``chosen_lb`` at the bar before, or not."""
    slow = F.create_map(*(x for n in lookbacks for x in (F.lit(n), F.col(f"slow_{n}"))))
    return F.when(F.coalesce(F.col("fast") > F.element_at(slow, chosen_lb), F.lit(False)), 1).otherwise(-1)


def regime_means(bars: DataFrame, lookbacks: tuple[int, ...], detect: str = "trend", keys: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Bars with their regime and, as of the bar before, the fast mean and that of every look-back."""
    means = with_ewm(DETECTORS[detect](bars).select(*keys, "bar_idx", "time", "open", "high", "low", "close", "regime"), [span(f"mean_{n}", "close", n) for n in sorted({FAST, *lookbacks})], keys)
    own = [lag(f"mean_{n}", 1, *keys).alias(f"slow_{n}") for n in lookbacks]
    return means.select(*keys, "bar_idx", "time", "open", "high", "low", "close", "regime", lag(f"mean_{FAST}", 1, *keys).alias("fast"), *own)


def regime_search(bars: DataFrame, labels: tuple[str, ...] = ("Uptrend", "Downtrend", "Ranging"), lookbacks: tuple[int, ...] = LOOKBACKS, costs: Costs = Costs(), least_trades: int = 10, detect: str = "trend") -> DataFrame:
    """``asset`` and, for each label, its look-back ``lb_LABEL`` and reward ``rrr_LABEL``.

    Labels are searched one after another, each with the choices of those before it and the default for
    those after: a loop on the driver over the labels, each step a sweep of all look-backs and assets. The
    reward is that of the trades entered in the label's regime, measured from their fills.
    """
    own = tuple(n for n in lookbacks if n != FAST)
    rows = written(regime_means(bars, tuple(sorted({*own, DEFAULT_LB})), detect))
    state = rows.select("asset").distinct().select("asset", *(F.lit(DEFAULT_LB).alias(f"lb_{x}") for x in labels), *(F.lit(None).cast("int").alias(f"rrr_{x}") for x in labels))
    slows = tuple(sorted({*own, DEFAULT_LB}))
    for label in labels:
        tried = rows.join(state, "asset").withColumn("lb", F.explode(F.array(*map(F.lit, own))))
        use = F.when(F.col("regime") == label, F.col("lb"))
        for other in labels:
            use = use.when(F.col("regime") == other, F.col(f"lb_{other}"))
        codes = flips(tried.withColumn("raw", by_regime(tried, slows, use)), "asset", "lb").select("asset", "lb", "bar_idx", "time", "open", "high", "low", "close", "code")
        keys = ("asset", "lb")
        probe = simulate(codes, costs.with_(target_pct=5 * costs.stop_pct, use_target=True), keys)
        entered = probe.join(rows.where(F.col("regime") == label).select("asset", F.col("bar_idx").alias("entry_idx")), ["asset", "entry_idx"], "left_semi")
        rrr = best_reward(filled_excursions(entered, rows, costs.stop_pct, keys), 5, keys).select(*keys, "rrr")
        runs = codes.join(rrr, list(keys), "left")
        results = metrics(simulate(runs, costs, keys, target=F.coalesce(F.col("rrr") * costs.stop_pct, F.lit(costs.target_pct))), costs, keys).join(rrr, list(keys), "left")
        best = ranked(results, least_trades=least_trades).where("rank = 1").select("asset", F.col("lb").alias("new_lb"), F.col("rrr").alias("new_rrr"))
        state = state.join(best, "asset", "left").withColumn(f"lb_{label}", F.col("new_lb")).withColumn(f"rrr_{label}", F.col("new_rrr")).drop("new_lb", "new_rrr")
        state = written(state)
    return state


def filled_excursions(trades: DataFrame, bars: DataFrame, stop_pct: float, keys: tuple[str, ...], most: float = 5.0) -> DataFrame:
    """As :func:`excursions`, from the prices that the trade was filled at."""
    held = trades.select(*keys, "trade_group_id", "side", "entry_price", "exit_price", F.explode(F.sequence("entry_idx", "exit_idx")).alias("bar_idx"))
    rows = held.join(bars.select("asset", "bar_idx", "high", "low"), ["asset", "bar_idx"])
    spread = rows.groupBy(*keys, "trade_group_id", "side", "entry_price", "exit_price").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    risk = F.col("entry_price") * stop_pct / 100
    peak = F.when(F.col("side") == 1, F.col("high") - F.col("entry_price")).otherwise(F.col("entry_price") - F.col("low")) / risk
    return spread.select(*keys, "trade_group_id", F.least(peak, F.lit(most)).alias("peak_r"), (F.col("side") * (F.col("exit_price") - F.col("entry_price")) / risk).alias("close_r"))


def regime_run(bars: DataFrame, lookbacks: dict[str, int], costs: Costs = Costs(), detect: str = "trend", blocked: DataFrame | None = None) -> DataFrame:
    """Metrics of the run whose look-back rotates with the regime, with the reward (one to five stops) that is best over it."""
    from quantspan.operators.regimes import filtered

    slows = tuple(sorted(set(lookbacks.values())))
    rows = regime_means(bars, slows, detect)
    use = F.element_at(F.create_map(*(x for k, v in lookbacks.items() for x in (F.lit(k), F.lit(v)))), F.col("regime"))
    rows = rows.withColumn("raw", by_regime(rows, slows, use))
    if blocked is not None:
        rows = filtered(rows, blocked, tuple(lookbacks)).drop("raw").withColumnRenamed("kept", "raw")
    codes = flips(rows, "asset").select("asset", "bar_idx", "time", "open", "high", "low", "close", "code")
    probe = simulate(codes, costs.with_(target_pct=5 * costs.stop_pct, use_target=True))
    rrr = best_reward(excursions(probe, bars, costs.stop_pct, ("asset",), 5.0), 5).select("asset", "rrr")
    own = costs.with_(use_target=True)
    results = metrics(simulate(codes.join(rrr, "asset", "left"), own, target=F.coalesce("rrr", F.lit(1)) * costs.stop_pct), own)
    return results.join(rrr, "asset", "left").withColumn("rrr", F.coalesce("rrr", F.lit(1)))


def regime_segments(parts: DataFrame, settings) -> DataFrame:
    """``parts``: bars with ``sample``. Look-backs by regime are searched in sample; metrics of both samples with them.

    The rotation is data: each asset's look-backs are joined to its bars, so assets need not agree.
    """
    labels, costs = settings.labels, settings.costs
    inside = parts.where("sample = 'IS'").drop("sample")
    state = regime_search(inside, labels, settings.lookbacks, costs, settings.least_trades, settings.detect)
    return _rotated(parts, state, labels, settings.lookbacks, costs, settings.detect, ("asset", "sample"))


def _rotated(parts: DataFrame, state: DataFrame, labels: tuple[str, ...], lookbacks: tuple[int, ...], costs: Costs, detect: str, keys: tuple[str, ...]) -> DataFrame:
    """Metrics by ``keys`` of runs whose look-back is the one that ``state`` has for the asset and the regime."""
    slows = tuple(sorted({*(n for n in lookbacks if n != FAST), DEFAULT_LB}))
    named = parts.withColumn("run", F.concat_ws("\u0001", *keys)).withColumn("own_asset", F.col("asset")).withColumn("asset", F.col("run"))
    rows = regime_means(named.select("asset", "bar_idx", "time", "open", "high", "low", "close"), slows, detect)
    rows = rows.join(named.select("asset", F.col("own_asset"), *(k for k in keys if k != "asset")).distinct(), "asset").drop("asset").withColumnRenamed("own_asset", "asset").join(state, "asset")
    use = None
    for label in labels:
        use = F.when(F.col("regime") == label, F.col(f"lb_{label}")) if use is None else use.when(F.col("regime") == label, F.col(f"lb_{label}"))
    codes = flips(rows.withColumn("raw", by_regime(rows, slows, use)), *keys).select(*keys, "bar_idx", "time", "open", "high", "low", "close", "code")
    probe = simulate(codes, costs.with_(target_pct=5 * costs.stop_pct, use_target=True), keys)
    rrr = best_reward(excursions(probe, parts, costs.stop_pct, keys, 5.0), 5, keys).select(*keys, "rrr")
    own = costs.with_(use_target=True)
    runs = codes.join(rrr, list(keys), "left").withColumn("rrr", F.coalesce("rrr", F.lit(1)))
    results = metrics(simulate(runs, own, keys, target=F.col("rrr") * costs.stop_pct), own, keys)
    return with_idle(results, runs.select(*keys, "rrr").distinct(), keys).join(state, "asset")


def regime_walk(bars: DataFrame, settings) -> DataFrame:
    """Walk-forward windows, each with look-backs by regime from its own sample. The windows of an asset are assets
    of one search, so that all are searched at once."""
    parts = windows(bars, settings.inside, settings.walk_step).withColumn("asset", F.concat_ws("\u0001", "asset", F.col("window_no").cast("string")))
    found = regime_segments(parts.select("asset", "sample", "bar_idx", "time", "open", "high", "low", "close"), settings)
    both = F.split("asset", "\u0001")
    return found.withColumn("window_no", both[1].cast("long")).withColumn("asset", both[0])
