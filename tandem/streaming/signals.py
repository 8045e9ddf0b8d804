"""Live trade signals: one arbitrary-state processor per (pair, model date).

Bars of a model arrive in any order.  They wait in a list state until the watermark has passed them, then they are
stepped in time order: running sums, the ring of the last look-back spreads, four exponential means and variances and
the open position move on by one bar.  What is kept is of constant size: one row of numbers, ``look + 1`` spreads, and
the bars that the watermark has not passed yet.

Rules: a bar behind the watermark is late and does not take part (Spark counts it; ``tandem.streaming.late`` can route
such rows to a table before); a bar that is delivered again is stepped once; a model without a bar for ``idle_secs`` of
event time is closed: its state goes, and a position that is still open is reported with the reason ``open``.
"""

from __future__ import annotations

import json
import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tandem.operators.signals import LEG_TRADE, V1, close_legs, step_v1

NAN = float("nan")
MODEL_STATE = ("n long, look int, x0 double, s1 double, s2 double, ema array<double>, var array<double>, z array<double>, std_high double, "
               "std_low double, ticks long, first_us long, last_us long, last_rn long, prev array<double>, last_prices array<double>, pos string")
RING_STATE = "x double"
WAITING_STATE = "us long, rn long, p1 double, p2 double, diff double, role int, look int, slope double, halflife_secs double"
_FIELDS = [f.split()[0] for f in MODEL_STATE.split(", ")]
_WAITING = [f.split()[0] for f in WAITING_STATE.split(", ")]


def to_time(us: int) -> pd.Timestamp:
    return pd.Timestamp(us, unit="us")


def to_micros(ts: pd.Timestamp) -> int:
    return int((ts - pd.Timestamp(0)) // pd.Timedelta(microseconds=1))


@dataclass
class SpreadState:
    """Features and position of one model, stepped by one bar at a time."""

    look: int
    n: int = 0
    x0: float = 0.0
    s1: float = 0.0
    s2: float = 0.0
    ema: list[float] = field(default_factory=list)
    var: list[float] = field(default_factory=list)
    z: list[float] = field(default_factory=lambda: [NAN] * 3)
    std_high: float = NAN
    std_low: float = NAN
    ticks: int = 0
    first_us: int = 0
    last_us: int = 0
    last_rn: int = -1
    prev: list[float] | None = None
    last_prices: list[float] = field(default_factory=lambda: [NAN, NAN])
    pos: dict | None = None
    ring: deque = field(default_factory=deque)

    def spans(self) -> list[int]:
        half = max(self.look // 2, 5)
        return [self.look, half, max(self.look // 2 // 2, 5), 5]

    def _averages(self, x: float) -> None:
        """Exponential means seeded by the first spread, variances by the first step."""
        if self.n == 0:
            self.ema, self.var = [x] * 4, [0.0] * 4
            return
        for k, span in enumerate(self.spans()):
            w = 2.0 / (1.0 + span)
            miss = (x - self.ema[k]) ** 2
            self.var[k] = miss if self.n == 1 else (1 - w) * self.var[k] + w * miss
            self.ema[k] = (1 - w) * self.ema[k] + w * x

    def _ring(self, x: float) -> None:
        """Sums around ``x0``; each time the ring has been renewed they are taken afresh, so that errors cannot pile up."""
        self.ring.append(x)
        gone = self.ring.popleft() if len(self.ring) > self.look + 1 else None
        if self.n % (self.look + 1) == 0:
            self.x0 = x
            self.s1 = math.fsum(v - x for v in self.ring)
            self.s2 = math.fsum((v - x) ** 2 for v in self.ring)
            return
        for v, sign in ((x, 1.0), (gone, -1.0)):
            if v is not None:
                self.s1 += sign * (v - self.x0)
                self.s2 += sign * (v - self.x0) ** 2

    def step(self, row: dict, limits: dict) -> dict | None:
        """Takes the next bar in; a trade if this bar closes one."""
        x = row["diff"]
        self._averages(x)
        self._ring(x)
        self.n += 1
        size = len(self.ring)
        self.last_us, self.last_rn, self.last_prices = row["us"], row["rn"], [row["p1"], row["p2"]]
        if row["role"] != 2:
            self.z = [0.0, *self.z[:2]]
            return None
        mean = self.x0 + self.s1 / size
        std = math.sqrt(max(0.0, (self.s2 - self.s1 * self.s1 / size) / (size - 1))) if size > 1 else NAN
        if std == std:
            self.std_high = std if self.std_high != self.std_high else max(self.std_high, std)
            self.std_low = std if self.std_low != self.std_low else min(self.std_low, std)
        z = (self.ema[3] - self.ema[0]) / math.sqrt(self.var[0]) if self.var[0] > 0 else NAN
        if self.ticks == 0:
            self.first_us = row["us"]
        self.ticks += 1
        now = {"p1": row["p1"], "p2": row["p2"], "diff": x, "slope": row["slope"], "halflife_secs": row["halflife_secs"], "ts": to_time(row["us"]),
               "secs": (row["us"] - self.first_us) / 1e6, "tick": self.ticks, "mean": mean, "std": std, "stdH": self.std_high, "stdL": self.std_low,
               "em_var": self.var[0], "z": z, "zp1": self.z[0], "zp2": self.z[1], "zp3": self.z[2]}
        prev = dict(zip(("diff", "mean", "std"), self.prev)) if self.prev else None
        self.pos, trade = step_v1(self.pos, now, prev, limits)
        self.prev, self.z = [x, mean, std], [z, *self.z[:2]]
        return trade

    def open_trade(self) -> dict | None:
        if self.pos is None:
            return None
        last = {"p1": self.last_prices[0], "p2": self.last_prices[1], "ts": to_time(self.last_us), "tick": self.ticks}
        return close_legs(self.pos, last, "open")

    def to_row(self) -> tuple:
        pos = None
        if self.pos:
            pos = json.dumps({**self.pos, "tm_o": to_micros(self.pos["tm_o"])}, default=float)
        return tuple(pos if f == "pos" else getattr(self, f) for f in _FIELDS)

    @staticmethod
    def of(row: tuple, ring) -> SpreadState:
        values = dict(zip(_FIELDS, row))
        for name in ("ema", "var", "z", "last_prices"):
            values[name] = list(values[name])
        values["prev"] = list(values["prev"]) if values["prev"] is not None else None
        if values["pos"]:
            values["pos"] = json.loads(values["pos"])
            values["pos"]["tm_o"] = to_time(values["pos"]["tm_o"])
        return SpreadState(**values, ring=deque(ring))


class SignalProcessor(StatefulProcessor):
    def __init__(self, limits: dict, idle_secs: int):
        self.limits, self.idle_ms = limits, idle_secs * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.model = handle.getValueState("model", MODEL_STATE)
        self.ring = handle.getListState("ring", RING_STATE)
        self.waiting = handle.getListState("waiting", WAITING_STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[_WAITING]
        if len(new):
            self.waiting.appendList([tuple(r) for r in new.astype(object).itertuples(index=False, name=None)])
            self.handle.registerTimer(-(-int(new["us"].min()) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = [dict(zip(_WAITING, r)) for r in self.waiting.get()] if self.waiting.exists() else []
        due = sorted((r for r in waiting if r["us"] <= passed), key=lambda r: r["rn"])
        state = SpreadState.of(self.model.get(), (r[0] for r in self.ring.get())) if self.model.exists() else None
        out = []
        if due:
            state = state or SpreadState(look=int(due[0]["look"]))
            for row in due:
                if row["rn"] > state.last_rn:  # else delivered again
                    trade = state.step(row, self.limits)
                    if trade:
                        out.append(trade)
            self._keep(state, [r for r in waiting if r["us"] > passed])
        elif state is not None and not waiting and passed >= state.last_us + self.idle_ms * 1000:
            if trade := state.open_trade():
                out.append(trade)
            for s in (self.model, self.ring, self.waiting):
                s.clear()
        return iter([self._frame(key, out)] if out else [])

    def _keep(self, state: SpreadState, rest: list[dict]) -> None:
        self.model.update(state.to_row())
        self.ring.put([(x,) for x in state.ring])
        if rest:
            self.waiting.put([tuple(r[f] for f in _WAITING) for r in rest])
            self.handle.registerTimer(-(-min(r["us"] for r in rest) // 1000))
        else:
            self.waiting.clear()
        self.handle.registerTimer(state.last_us // 1000 + self.idle_ms)

    @staticmethod
    def _frame(key, out: list[dict]) -> pd.DataFrame:
        names = [f.split()[0] for f in LEG_TRADE.split(", ")]
        d = pd.DataFrame(out, columns=names[3:])
        d["n1"], d["n2"], d["model_date"] = key
        return d[names]

    def close(self) -> None:
        pass


def live_signals(rows: DataFrame, limits: dict | None = None, delay: str = "0 seconds", idle_secs: int = 7 * 86_400) -> DataFrame:
    """v1 trades of each (pair, model date) as its bars arrive; start it inside ``feeds.rocks_state``.

    ``rows`` are those of ``operators.spreads.warm_start`` with slope and halflife_secs; ``ts`` is the event time.
    History rows (role 0) only feed the long window, which no signal reads, and are left out before the shuffle.
    """
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    need = rows.select("n1", "n2", "model_date", F.col("ts").cast("timestamp").alias("event_ts"), us.alias("us"), "rn", "p1", "p2", "diff", "role",
                       F.col("lookback").cast("int").alias("look"), "slope", F.col("halflife_secs").cast("double").alias("halflife_secs"))
    live = need.where("role > 0").withWatermark("event_ts", delay)
    return live.groupBy("n1", "n2", "model_date").transformWithStateInPandas(
        SignalProcessor({**V1, **(limits or {})}, idle_secs), LEG_TRADE, "append", "eventTime")
