"""Trade simulation bar by bar, for what a relational plan cannot decide: hold caps, session ends, exit codes
and codes of one side in a row. One group a key; the relational plan is the one to use where it applies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspan.config import Costs
from quantspan.operators.simulate import funding_bar


def simulate_sequential(signals: DataFrame, costs: Costs = Costs(), keys: tuple[str, ...] = ("asset",), session: str | None = None, session_end: str | None = None) -> DataFrame:
    """As :func:`simulate`, and for currency pairs (``costs.pip``); ``code`` may also be 2 or 4 (close a long, a short). ``session`` and
    ``session_end`` name boolean columns: bars outside are skipped, positions close at an end bar's open."""
    both = [F.col(session) if session else F.lit(True), F.col(session_end) if session_end else F.lit(False)]
    rows = signals.select(*keys, "bar_idx", "open", "high", "low", "code", funding_bar().alias("funded"), both[0].alias("inside"), both[1].alias("ending"))

    def run(bars: pd.DataFrame) -> pd.DataFrame:
        bars = bars.sort_values("bar_idx")
        idx, o, h, low, code = (bars[c].to_numpy() for c in ("bar_idx", "open", "high", "low", "code"))
        trades: list[tuple] = []
        side = entered = 0
        entry = qty = paid = 0.0

        def leave(k: int, raw: float, kind: str) -> None:
            nonlocal side, paid
            price = raw * (1 - side * costs.slip)
            fee = (costs.position + qty * price) * costs.fee
            move = qty * side * (price - entry)
            if costs.pip:  # in risks: a stop is one lost, a target the ratio won, other exits lie between
                ratio = costs.target_pct / costs.stop_pct
                risks = {"stop": -1.0, "target": ratio}.get(kind, min(max(side * (price - entry) / (costs.stop_pct * costs.pip), -1.0), ratio))
                move = risks * costs.position
            elif costs.clamp and costs.stop_pct > 0:
                risk = qty * entry * costs.stop_pct / 100
                move = max(min(move, risk * costs.target_pct / costs.stop_pct), -risk)
            slippage = 0.0 if costs.pip else qty * costs.slip * (entry / (1 + side * costs.slip) + price / (1 - side * costs.slip))
            net = move - fee - paid
            trades.append((len(trades), 0, side, int(idx[entered]), int(idx[k]), entry, price, qty, net, fee, slippage, paid, net + fee + slippage + paid, net, kind))
            side, paid = 0, 0.0

        for k in np.flatnonzero(bars["inside"].to_numpy()):
            if side and bars["funded"].iat[k]:
                paid += qty * o[k] * costs.funding
            if idx[k] < costs.mute_bars:
                continue
            act, ending = int(code[k]), bool(bars["ending"].iat[k])
            capped = side and not ending and costs.max_hold > 0 and k - entered >= costs.max_hold
            if side and (ending or capped):
                act = 2 if side == 1 else 4
            elif ending and act in (1, 3):
                act = 0
            if side and act not in (1, 3) and not ending:
                stop, target = (entry - side * costs.stop_pct * costs.pip, entry + side * costs.target_pct * costs.pip) if costs.pip else (entry * (1 - side * costs.stop_pct / 100), entry * (1 + side * costs.target_pct / 100))
                on_stop = low[k] <= stop if side == 1 else h[k] >= stop
                on_target = not on_stop and (h[k] >= target if side == 1 else low[k] <= target)
                if costs.use_stop and on_stop or costs.use_target and on_target:
                    leave(k, stop if on_stop else target, "stop" if on_stop else "target")
                    continue
            wanted = {1: 1, 3: -1}.get(act, 0)
            if wanted and side == -wanted:
                leave(k, o[k], "flip")
            if wanted and not side:
                side, entered = wanted, k
                entry = o[k] * (1 + side * costs.slip)
                qty = costs.position / entry
            elif act == 2 and side == 1 or act == 4 and side == -1:
                leave(k, o[k], "session" if ending else "hold" if capped else "close")
        if side:
            leave(len(o) - 1, o[-1], "end")
        out = pd.DataFrame(trades, columns=["trade_group_id", "leg_id", "side", "entry_idx", "exit_idx", "entry_price", "exit_price", "qty", "pnl", "fee", "slippage", "funding", "gross_pnl", "net_pnl", "exit_kind"])
        for place, key in enumerate(keys):
            out.insert(place, key, bars[key].iat[0])
        return out

    fields = ", ".join(f"{k} {signals.schema[k].dataType.simpleString()}" for k in keys)
    return rows.groupBy(*keys).applyInPandas(run, f"{fields}, trade_group_id long, leg_id int, side int, entry_idx long, exit_idx long, entry_price double, exit_price double, qty double, pnl double, fee double, slippage double, funding double, gross_pnl double, net_pnl double, exit_kind string")
