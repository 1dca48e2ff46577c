"""Pieces of the SQL that the queries are checked against."""

from __future__ import annotations

import re

BARS = """bars AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY time) - 1 AS bar_idx FROM (
  SELECT event_type AS asset, date_trunc('hour', ts)::TIMESTAMP AS time, arg_min(value + 100.0, (ts, event_id)) AS open, max(value + 100.0) AS high,
    min(value + 100.0) AS low, arg_max(value + 100.0, (ts, event_id)) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2))"""
W = "PARTITION BY asset ORDER BY bar_idx"


def rows(n: int, end: int = 0) -> str:
    """The last n rows up to the current one, or up to the one before it."""
    return f"({W} ROWS BETWEEN {n - 1 + end} PRECEDING AND {'CURRENT ROW' if not end else '1 PRECEDING'})"


def full(agg: str, x: str, n: int) -> str:
    return f"(CASE WHEN count({x}) OVER {rows(n)} = {n} THEN {agg}({x}) OVER {rows(n)} END)"


def ema(x: str, alpha: float) -> str:
    """Seeded by the first value; good for the some hundred bars of the check."""
    r = 1 - alpha
    return f"(power({r!r}, bar_idx) * sum(CASE WHEN bar_idx = 0 THEN {x} ELSE {alpha!r} * {x} * power({r!r}, -bar_idx) END) OVER ({W}))"


def ewm(x: str, alpha: float, least: int) -> str:
    """Weights normalised over what there is, null until there are ``least`` values."""
    r = 1 - alpha
    return f"(CASE WHEN bar_idx + 1 >= {least} THEN sum({x} * power({r!r}, -bar_idx)) OVER ({W}) / sum(power({r!r}, -bar_idx)) OVER ({W}) END)"


def span(n: int) -> float:
    return 2.0 / (n + 1)


def crossed(slow: int = 50, fast: int = 20) -> str:
    """Bars with the raw signal of the EMA cross and its flips."""
    return f"""{BARS}, emas AS (SELECT *, {ema('close', span(fast))} AS ef, {ema('close', span(slow))} AS es FROM bars),
raws AS (SELECT *, coalesce(sign(lag(ef) OVER ({W}) - lag(es) OVER ({W})), 0)::INT AS raw FROM emas),
held AS (SELECT *, coalesce(last_value(nullif(raw, 0) IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM raws),
codes AS (SELECT *, CASE WHEN raw <> 0 AND raw <> held THEN CASE raw WHEN 1 THEN 1 ELSE 3 END ELSE 0 END AS code FROM held)"""


def trades(source: str = "codes", keys: str = "asset", fee: str = "0.0002", slip: str = "0.0003", stop: str = "1.0", target: str = "3.0", name: str = "trades", clamp: bool = False, use_stop: bool = True, use_target: bool = True, funding: str = "0.0001") -> str:
    """The trade simulation of ``source`` (keys, bar_idx, time, prices, code)."""
    on = f"PARTITION BY {keys} ORDER BY bar_idx"
    equal = " AND ".join(f"e.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    same = " AND ".join(f"s.{k.strip()} = e.{k.strip()}" for k in keys.split(","))
    k, p = ", ".join(f"e.{x.strip()}" for x in keys.split(",")), name
    hit = " OR ".join([*(["on_stop"] * use_stop), *(["(on_target AND NOT on_stop)"] * use_target)]) or "false"
    move = "qty * side * (exit_price - entry_price)"
    if clamp:
        move = f"greatest(least({move}, qty * entry_price * ({stop}) / 100 * ({target}) / ({stop})), -qty * entry_price * ({stop}) / 100)"
    return f"""{p}_s AS (SELECT *, sum(CASE WHEN code <> 0 THEN 1 ELSE 0 END) OVER ({on}) AS segment, sum(CASE WHEN hour(time) IN (0, 8, 16) AND minute(time) = 0 THEN open ELSE 0 END) OVER ({on}) AS funded FROM {source}),
{p}_l AS (SELECT {keys}, arg_max(open, bar_idx) AS last_open, max(bar_idx) AS last_idx, arg_max(funded, bar_idx) AS last_funded FROM {p}_s GROUP BY {keys}),
{p}_e AS (SELECT *, CASE code WHEN 1 THEN 1 ELSE -1 END AS side, open * (1 + (CASE code WHEN 1 THEN 1 ELSE -1 END) * ({slip})) AS entry_price,
  lead(bar_idx) OVER ({on}) AS next_idx, lead(open) OVER ({on}) AS next_open, lead(funded) OVER ({on}) AS next_funded FROM {p}_s WHERE code <> 0),
{p}_h AS (SELECT {k}, e.segment, s.bar_idx, s.funded, CASE WHEN on_stop THEN entry_price * (1 - side * ({stop}) / 100) ELSE entry_price * (1 + side * ({target}) / 100) END AS price, CASE WHEN on_stop THEN 'stop' ELSE 'target' END AS kind
  FROM (SELECT {keys}, segment, bar_idx AS entry_idx, side, entry_price{"".join(f", {c}" for c in ("fee_x", "slip_x", "stop_x", "target_x") if c in fee + slip + stop + target)} FROM {p}_e) e JOIN (SELECT {keys}, segment, bar_idx, funded, high, low FROM {p}_s) s ON {same} AND s.segment = e.segment AND s.bar_idx > e.entry_idx,
  LATERAL (SELECT CASE WHEN side = 1 THEN s.low <= entry_price * (1 - side * ({stop}) / 100) ELSE s.high >= entry_price * (1 - side * ({stop}) / 100) END AS on_stop, CASE WHEN side = 1 THEN s.high >= entry_price * (1 + side * ({target}) / 100) ELSE s.low <= entry_price * (1 + side * ({target}) / 100) END AS on_target) WHERE {hit}),
{p}_f AS (SELECT {keys}, segment, min(bar_idx) AS hit_idx, arg_min(price, bar_idx) AS hit_price, arg_min(funded, bar_idx) AS hit_funded, arg_min(kind, bar_idx) AS hit_kind FROM {p}_h GROUP BY {keys}, segment),
{p}_x AS (SELECT e.*, coalesce(hit_idx, next_idx, last_idx) AS exit_idx, coalesce(hit_price, next_open, last_open) * (1 - side * ({slip})) AS exit_price, coalesce(hit_funded, next_funded, last_funded) AS exit_funded,
  CASE WHEN hit_idx IS NOT NULL THEN hit_kind WHEN next_idx IS NOT NULL THEN 'flip' ELSE 'end' END AS exit_kind, 2500.0 / entry_price AS qty
  FROM {p}_e e LEFT JOIN {p}_f f USING ({keys}, segment) JOIN {p}_l USING ({keys})),
{p}_p AS (SELECT *, (2500.0 + qty * exit_price) * ({fee}) AS fee, qty * {funding} * (exit_funded - funded) AS funding FROM {p}_x),
{p} AS (SELECT {keys}, (segment - 1)::BIGINT AS trade_group_id, 0 AS leg_id, side, bar_idx AS entry_idx, exit_idx, entry_price, exit_price, qty, {move} - fee - funding AS pnl, fee,
  qty * ({slip}) * (entry_price / (1 + side * ({slip})) + exit_price / (1 - side * ({slip}))) AS slippage, funding, exit_kind FROM {p}_p)"""


def stepped(source: str, hold: int = 0, inside: str = "true", ending: str = "false", pip: float = 0.0) -> str:
    """The simulation of ``source`` bar by bar, as a recursion over bars: ``st`` (trades); the WITH must be recursive."""
    position, funding, slip = (1.0, 0.0, 0.03 * pip) if pip else (2500.0, 0.0001, 0.0003)
    stop = f"px - side * {100 * pip}" if pip else "px * (1 - side * 1.0 / 100)"
    target = f"px + side * {300 * pip}" if pip else "px * (1 + side * 3.0 / 100)"
    move = f"CASE kind WHEN 'stop' THEN -1.0 WHEN 'target' THEN 3.0 ELSE least(greatest(side * (price - px) / {100 * pip}, -1.0), 3.0) END" if pip else "qty * side * (price - px)"
    pnl = f"{move} - ({position} + qty * price) * 0.0002"
    return f"""bb AS (SELECT asset, bar_idx AS i, open, high, low, code, hour(time) IN (0, 8, 16) AND minute(time) = 0 AS funded, {inside} AS inside, {ending} AS ending FROM {source}),
rc AS (SELECT DISTINCT asset, -1::BIGINT AS i, 0 AS side, -1::BIGINT AS ent, 0.0::DOUBLE AS px, 0.0::DOUBLE AS qty, 0.0::DOUBLE AS paid, NULL::INT AS c_side, NULL::BIGINT AS c_ent, NULL::VARCHAR AS c_kind, NULL::DOUBLE AS c_pnl FROM bb
 UNION ALL SELECT asset, i, CASE WHEN enters THEN want WHEN kind IS NOT NULL THEN 0 ELSE side END, CASE WHEN enters THEN i ELSE ent END, CASE WHEN enters THEN open * (1 + want * {slip}) ELSE px END, CASE WHEN enters THEN {position} / (open * (1 + want * {slip})) ELSE qty END, CASE WHEN enters OR kind IS NOT NULL THEN 0.0 ELSE paid2 END,
  CASE WHEN kind IS NOT NULL THEN side END, CASE WHEN kind IS NOT NULL THEN ent END, kind, CASE WHEN kind IS NOT NULL THEN {pnl} - paid2 END
 FROM (SELECT *, raw * (1 - side * {slip}) AS price, kind IS DISTINCT FROM 'stop' AND kind IS DISTINCT FROM 'target' AND want <> 0 AND (side = 0 OR kind = 'flip') AS enters
 FROM (SELECT *, CASE WHEN on_stop THEN 'stop' WHEN on_target THEN 'target' WHEN want <> 0 AND side = -want THEN 'flip' WHEN (act = 2 AND side = 1) OR (act = 4 AND side = -1) THEN CASE WHEN ending THEN 'session' WHEN capped THEN 'hold' ELSE 'close' END END AS kind, CASE WHEN on_stop THEN stop WHEN on_target THEN target ELSE open END AS raw
 FROM (SELECT *, tested AND CASE WHEN side = 1 THEN low <= stop ELSE high >= stop END AS on_stop, tested AND NOT CASE WHEN side = 1 THEN low <= stop ELSE high >= stop END AND CASE WHEN side = 1 THEN high >= target ELSE low <= target END AS on_target, CASE act WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS want
 FROM (SELECT *, inside AND side <> 0 AND act NOT IN (1, 3) AND NOT ending AS tested, {stop} AS stop, {target} AS target
 FROM (SELECT *, CASE WHEN NOT inside THEN 0 WHEN side <> 0 AND (ending OR capped) THEN CASE side WHEN 1 THEN 2 ELSE 4 END WHEN ending AND code IN (1, 3) THEN 0 ELSE code END AS act
 FROM (SELECT bb.*, side, ent, px, qty, paid + CASE WHEN inside AND side <> 0 AND funded THEN qty * open * {funding} ELSE 0 END AS paid2, inside AND side <> 0 AND NOT ending AND {hold} > 0 AND bb.i - ent >= {hold} AS capped FROM rc JOIN bb ON bb.asset = rc.asset AND bb.i = rc.i + 1))))))),
fin AS (SELECT rc.asset, side, ent, i, px, qty, paid, open * (1 - side * {slip}) AS price, 'end' AS kind FROM rc JOIN bb USING (asset, i) WHERE side <> 0 AND i = (SELECT max(i) FROM bb z WHERE z.asset = rc.asset)),
st AS (SELECT asset, row_number() OVER (PARTITION BY asset ORDER BY c_ent) - 1 AS trade_group_id, c_side AS side, c_ent AS entry_idx, i AS exit_idx, c_kind AS exit_kind, c_pnl AS pnl FROM (SELECT asset, c_side, c_ent, i, c_kind, c_pnl FROM rc WHERE c_kind IS NOT NULL UNION ALL SELECT asset, side, ent, i, kind, {pnl} - paid FROM fin))"""


def metrics(source: str = "trades", keys: str = "asset", exact: bool = False) -> str:
    on = f"PARTITION BY {keys} ORDER BY trade_group_id"
    weights = (0.0117, 0.0317, 0.0861, 0.2341, 0.6364)
    edges = " ".join(f"+ (CASE WHEN place >= {' + '.join(f'((n + {j}) // 5)' for j in range(k + 1))} THEN 1 ELSE 0 END)" for k in range(4))
    out = f"""SELECT {keys}, count(*)::BIGINT AS trades, round(sum(ret), 6) AS roi, CASE WHEN count(*) FILTER (ret <= 0) = 0 THEN 'inf'::DOUBLE ELSE round(coalesce(sum(ret) FILTER (ret > 0), 0) / nullif(-sum(ret) FILTER (ret <= 0), 0), 4) END AS pf,
  round(avg((ret > 0)::INT::DOUBLE), 6) AS win_rate, round(coalesce(avg(ret) FILTER (ret > 0), 0) * avg((ret > 0)::INT::DOUBLE) - coalesce(avg(-ret) FILTER (ret <= 0), 0) * (1 - avg((ret > 0)::INT::DOUBLE)), 8) AS exp,
  round(CASE WHEN count(*) > 1 AND stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(count(*)) ELSE 0 END, 5) AS sharpe, round(max(dd), 6) AS max_drawdown,
  round(0.6 * sum(list_extract({list(weights)}, (0 {edges} + 1)::BIGINT) * ret) + 0.4 * sum(ret), 6) AS consistency
FROM (SELECT *, (greatest(max(eq) OVER ({on} ROWS UNBOUNDED PRECEDING), 1.0) - eq) / greatest(max(eq) OVER ({on} ROWS UNBOUNDED PRECEDING), 1.0) AS dd FROM (
  SELECT *, pnl / 100000.0 AS ret, 1 + sum(pnl / 100000.0) OVER ({on} ROWS UNBOUNDED PRECEDING) AS eq, row_number() OVER ({on}) - 1 AS place, count(*) OVER (PARTITION BY {keys}) AS n FROM {source})) GROUP BY {keys}"""
    return re.sub(r", (4|5|6|8)\) AS (roi|win_rate|exp|sharpe|max_drawdown|consistency)\b", r", 15) AS \2", out).replace(", 0), 4) END AS pf", ", 0), 15) END AS pf") if exact else out
