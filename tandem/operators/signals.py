"""Trades out of ordered rows: one transition function per strategy.

A transition takes the position state and one row and returns the new state
and a closed trade or None.  Batch scans apply it per (pair, model date), the
stream applies the same function to its stored state.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tandem.functions.ordered import carry_forward, running_sum
from tandem.functions.timeline import epoch_seconds
from tandem.operators.features import lagged, sma_cross_signal
from tandem.sources.shared import written
from tandem.operators.spreads import FEE_PER_SHARE, TRADE_AMOUNT, Z_HIGH, Z_LOW, features_of

Z_TRADE = "n1 string, n2 string, model_date date, rt double, dz double, z0 double, z double, std_xy_percent double, stop int"
LEG_TRADE = ("n1 string, n2 string, model_date date, profit double, x0 double, x1 double, pos_x bigint, y0 double, y1 double, "
             "pos_y bigint, tm_o timestamp_ntz, tm_c timestamp_ntz, tick_o bigint, tick_c bigint, reason string")


def _outward(z: float, before: float) -> bool:
    """z is still moving away from zero."""
    return (before < 0 and z < before) or (before > 0 and z > before)


def step_z_trailing(pos: dict | None, row: dict, before: float, enter: float = 2.0, move: float = 1.0):
    """Entry beyond two deviations once z turns; stop and profit one deviation away."""
    z, x, y = row["z"], row["x"], row["y"]
    if pos is None:
        if row["new_day"] or _outward(z, before) or abs(z) <= enter:
            return None, None
        side = 1 if z < 0 else -1
        return {"z0": z, "x": x, "y": y, "px": side * 100 * row["s"], "py": -side * 100}, None
    sign = -1 if pos["z0"] < 0 else 1
    gone = (z - pos["z0"]) * sign  # > 0: further out than at entry
    inward = (z - before) * sign < 0
    if row["new_day"] or gone > move or (not inward and gone < -move):
        gain = (x - pos["x"]) * pos["px"] + (y - pos["y"]) * pos["py"]
        base = max(abs(pos["px"] * pos["x"]), abs(pos["py"] * pos["y"]))
        trade = {"rt": gain / base * 100, "dz": z - pos["z0"], "z0": pos["z0"], "z": z,
                 "std_xy_percent": 100 * row["st"] / max(pos["x"], pos["y"]), "stop": int(row["new_day"] or gone > move)}
        return None, trade
    return pos, None


def _scan_z(g: pd.DataFrame) -> pd.DataFrame:
    g = g.sort_values("ts")
    day = g["ts"].dt.date.to_numpy()
    rows = g[["z", "x", "y", "s", "st"]].to_dict("records")
    pos, before, out = None, 0.0, []
    for k, row in enumerate(rows):
        row["new_day"] = day[k] != day[0]
        pos, trade = step_z_trailing(pos, row, before)
        if trade:
            out.append(trade)
        if row["new_day"]:
            break
        before = row["z"]
    f = pd.DataFrame(out, columns=["rt", "dz", "z0", "z", "std_xy_percent", "stop"])
    for c in ("n1", "n2", "model_date"):
        f[c] = g[c].iloc[0]
    return f[["n1", "n2", "model_date", "rt", "dz", "z0", "z", "std_xy_percent", "stop"]]


def trades_z_trailing(rows: DataFrame) -> DataFrame:
    """``rows(n1, n2, model_date, ts, x, y, z, s, st)`` of one test day each; trades still open at the end are left out."""
    need = rows.select("n1", "n2", "model_date", "ts", "x", "y", "z", "s", "st")
    return need.groupBy("n1", "n2", "model_date").applyInPandas(_scan_z, Z_TRADE)


def half_away(v: float) -> int:
    return int(math.floor(abs(v) + 0.5) * (1 if v >= 0 else -1))


def open_legs(x: float, y: float, slope: float, direction: int, amount: float = TRADE_AMOUNT) -> tuple[int, int]:
    py = half_away(amount / y)
    px = half_away(py * slope)
    if px * x > amount:
        px = half_away(amount / x)
        py = half_away(px / slope)
    return (-px, py) if direction > 0 else (px, -py)


def close_legs(pos: dict, row: dict, reason: str) -> dict:
    gain = (row["p1"] - pos["x0"]) * pos["pos_x"] + (row["p2"] - pos["y0"]) * pos["pos_y"]
    return {"profit": gain - FEE_PER_SHARE * (abs(pos["pos_x"]) + abs(pos["pos_y"])), "x0": pos["x0"], "x1": row["p1"],
            "pos_x": pos["pos_x"], "y0": pos["y0"], "y1": row["p2"], "pos_y": pos["pos_y"], "tm_o": pos["tm_o"],
            "tm_c": row["ts"], "tick_o": pos["tick_o"], "tick_c": row["tick"], "reason": reason}


def _enter(row: dict, direction: int, **extra) -> dict:
    px, py = open_legs(row["p1"], row["p2"], row["slope"], direction)
    return {"pos_x": px, "pos_y": py, "x0": row["p1"], "y0": row["p2"], "tm_o": row["ts"], "tick_o": row["tick"], **extra}


def step_v0(pos: dict | None, row: dict, before: float):
    """Two-deviation entry; exits by three hours, half-life, turn in profit, or loss of one deviation."""
    z, since = row["z"], row["secs"]
    late = since > 3 * 3600
    if pos is None:
        if late or _outward(z, before) or abs(z) <= 2.0:
            return None, None
        return _enter(row, 1 if z > 0 else -1, z0=z, secs_o=since), None
    sign = -1 if pos["z0"] < 0 else 1
    inward = (z - before) * sign < 0
    ahead = (z - pos["z0"]) * sign < 0
    if late:
        return None, close_legs(pos, row, "force")
    if since - pos["secs_o"] > row["halflife_secs"]:
        return None, close_legs(pos, row, "timeout")
    if not inward:
        if ahead and abs(before - pos["z0"]) > 1.3:
            return None, close_legs(pos, row, "profit")
        if not ahead and abs(z - pos["z0"]) > 1.0:
            return None, close_legs(pos, row, "stop")
    return pos, None


# Fixed limits of the v1 strategy.
V1 = dict(max_loss=300.0, min_std_rate=0.004, delay_secs=900, std_percent=0.3, session_secs=5 * 3600)


def step_v1(pos: dict | None, row: dict, prev: dict | None, limits: dict = V1):
    """Cross-in entry; exits by trailing flags, loss, profit cap, twice the half-life or a re-crossed line.

    The bands of an open position are those of the bar before.
    """
    if pos is None:
        rate = math.sqrt(max(row["em_var"], 0.0)) / (row["p1"] * row["slope"] + row["p2"])
        if (rate < limits["min_std_rate"] or row["halflife_secs"] > limits["session_secs"] - row["secs"]
                or row["secs"] < limits["delay_secs"]):
            return None, None
        width = row["stdH"] - row["stdL"]
        if width > 0 and (row["std"] - row["stdL"]) / width < limits["std_percent"]:
            return None, None
        z0, z1, z2, z3 = row["z"], row["zp1"], row["zp2"], row["zp3"]
        direction = 0
        if Z_LOW <= z0 <= Z_HIGH and z1 > Z_HIGH and z1 <= z2 <= z3:
            direction = 1
        elif -Z_HIGH <= z0 <= -Z_LOW and z1 < -Z_HIGH and z1 >= z2 >= z3:
            direction = -1
        if direction == 0:
            return None, None
        cap = row["mean"] + 0.25 * z0 * row["std"]
        return _enter(row, direction, side=direction, cap=cap, crossed=[False] * 4, secs_o=row["secs"]), None
    side = pos["side"]
    lines = [(prev["diff"] - (prev["mean"] - k * side * prev["std"])) * side for k in (3, 2, 1, 0)]
    if (row["diff"] - prev["diff"]) * side < 0:  # still running our way: remember the lines behind
        return {**pos, "crossed": [c or v < 0 for c, v in zip(pos["crossed"], lines)]}, None
    reason = None
    if close_legs(pos, row, "")["profit"] < -limits["max_loss"]:
        reason = "loss"
    elif (row["diff"] - pos["cap"]) * side <= 0:
        reason = "cap"
    elif 2 * row["halflife_secs"] < row["secs"] - pos["secs_o"]:
        reason = "timeout"
    elif any(c and v > 0 for c, v in zip(pos["crossed"], lines)):
        reason = "line"
    return (None, close_legs(pos, row, reason)) if reason else (pos, None)


def _leg_frame(out: list[dict], g: pd.DataFrame) -> pd.DataFrame:
    names = [f.split()[0] for f in LEG_TRADE.split(", ")]
    f = pd.DataFrame(out, columns=names[3:])
    for c in ("n1", "n2", "model_date"):
        f[c] = g[c].iloc[0]
    return f[names]


def trades_v0(rows: DataFrame, max_trades: int = 1) -> DataFrame:
    """``rows(n1, n2, model_date, ts, p1, p2, z, slope, halflife_secs)`` of one test range each."""
    def scan(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ts")
        secs = (g["ts"] - g["ts"].iloc[0]).dt.total_seconds().to_numpy()
        pos, before, out = None, 0.0, []
        for k, row in enumerate(g.to_dict("records")):
            row.update(secs=secs[k], tick=k + 1)
            pos, trade = step_v0(pos, row, before)
            if trade:
                out.append(trade)
                if len(out) >= max_trades:
                    break
            before = row["z"]
        return _leg_frame(out, g)

    need = rows.select("n1", "n2", "model_date", "ts", "p1", "p2", "z", "slope", "halflife_secs")
    return need.groupBy("n1", "n2", "model_date").applyInPandas(scan, LEG_TRADE)


def trades_v1(rows: DataFrame, limits: dict | None = None) -> DataFrame:
    """``rows`` of :func:`tandem.operators.spreads.warm_start`, plus slope and halflife_secs."""
    used = {**V1, **(limits or {})}

    def scan(g: pd.DataFrame) -> pd.DataFrame:
        d = features_of(g)
        pos, prev, out = None, None, []
        start = d["ts"].iloc[0] if len(d) else None
        for k, row in enumerate(d.to_dict("records")):
            row.update(secs=(row["ts"] - start).total_seconds(), tick=k + 1)
            pos, trade = step_v1(pos, row, prev, used)
            if trade:
                out.append(trade)
            prev = row
        return _leg_frame(out, g)

    need = rows.select("n1", "n2", "model_date", "ts", "rn", "p1", "p2", "diff", "lookback", "end_ts", "model_start_ts",
                       "role", "slope", "halflife_secs")
    return need.groupBy("n1", "n2", "model_date").applyInPandas(scan, LEG_TRADE)


def trades_sma_cross(bars: DataFrame, fast: int = 5, slow: int = 15, slice_rows: int = 10_000) -> DataFrame:
    """Long-only round trips of the moving-average cross, natively.

    The state is the last non-zero signal; an entry is carried to the exit that
    ends it.
    """
    d = sma_cross_signal(bars, fast, slow).withColumn("_slice", F.floor(F.col("rn") / slice_rows))
    d = d.withColumn("_sig", F.when(F.col("signal") != 0, F.col("signal")))
    d = carry_forward(d, ["symbol"], ["rn"], "_slice", "_sig", "_state")
    d = lagged(d, "_state", 1, "_before")
    entry = (F.col("_state") == 1) & (F.coalesce("_before", F.lit(-1)) != 1)
    leave = (F.col("_state") == -1) & (F.col("_before") == 1)
    # Entries and exits alternate; only these few rows go on, read twice by the carry.
    flips = written(d.where(entry | leave).select("symbol", "ts", "rn", "_slice", "close", entry.alias("_enter")), "flips")
    opened = flips.withColumn("_open", F.when(F.col("_enter"), F.struct(F.col("ts").alias("t"), F.col("close").alias("c"))))
    d = carry_forward(opened, ["symbol"], ["rn"], "_slice", "_open", "_from").where(~F.col("_enter"))
    return d.select("symbol", F.col("_from.t").alias("tm_o"), F.col("ts").alias("tm_c"),
                    F.col("_from.c").alias("price_o"), F.col("close").alias("price_c"),
                    (F.col("close") - F.col("_from.c")).alias("profit"))


START_CASH = 100_000.0


def capital_usage(trades: DataFrame, scenario: str = "model_date", slice_secs: int = 86_400) -> DataFrame:
    """Cash and frozen margin of each scenario after all events of each time."""
    cap_x, cap_y = F.col("pos_x") * F.col("x0"), F.col("pos_y") * F.col("y0")
    short = -F.least(cap_x, cap_y)
    fee = FEE_PER_SHARE * (F.abs("pos_x") + F.abs("pos_y"))
    back = F.when(F.col("pos_x") > 0, F.col("x1") * F.col("pos_x") + (F.col("y1") - F.col("y0")) * F.col("pos_y")
                  ).otherwise(F.col("y1") * F.col("pos_y") + (F.col("x1") - F.col("x0")) * F.col("pos_x"))
    event = lambda tm, cash, margin: F.struct(F.col(tm).alias("tm"), cash.cast("double").alias("cash_change"),
                                              margin.cast("double").alias("margin_change"))
    rows = trades.select(scenario, F.explode(F.array(
        event("tm_o", -F.greatest(cap_x, cap_y), short), event("tm_c", back - fee, -short))).alias("_e")).select(scenario, "_e.*")
    steps = (rows.groupBy(scenario, "tm").agg(F.sum("cash_change").alias("cash_change"), F.sum("margin_change").alias("margin_change"))
             .withColumn("_slice", F.floor(epoch_seconds("tm") / slice_secs)))
    steps = running_sum(steps, [scenario], ["tm"], "_slice", "cash_change", "_cash")
    steps = running_sum(steps, [scenario], ["tm"], "_slice", "margin_change", "margin")
    return steps.withColumn("cash", F.lit(START_CASH) + F.col("_cash")).drop("_cash", "_slice")


def rank_contracts(rows: DataFrame, time: str = "ts", rank: str = "rank") -> DataFrame:
    """Order of the contracts within each bar: by rank, then name (a bar holds at most the pair universe)."""
    w = Window.partitionBy(time).orderBy(rank, "pair")
    return rows.where(F.col(rank) != 0).withColumn("place", F.row_number().over(w))
