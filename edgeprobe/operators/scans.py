"""Recursive scans: what a bounded window can't express, without a task that has a whole symbol.

A machine's state goes from one bar to the next.  A block of bars is boiled down to a table that says, for every state that it may begin
with, which one it ends with.  A prefix pass over a symbol's tables gives the state that each block really begins with, and then all blocks are replayed side by
side.  Tables are exact: finite states are followed together, and where positions are real numbers the table has the few values that the
outcome hangs on.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import DAYS, block_of


def by_symbol(rows: DataFrame, f, schema: str, order: str = "ts", by: list[str] | None = None) -> DataFrame:
    """f over each symbol's rows in order."""
    return rows.groupBy(*(by or ["symbol"])).applyInPandas(lambda b: f(b.sort_values(order, kind="stable").reset_index(drop=True)), schema)


class Finite:
    """A machine with numbered states: ``step`` of an array of states and a value, ``positions`` of states, ``start``."""

    states: int
    start: int

    def step(self, states, value):
        raise NotImplementedError

    def positions(self, states):
        raise NotImplementedError

    def table(self, x) -> list[int]:
        """The end of each state.  States that have met are followed as one."""
        import numpy as np

        left, of = np.arange(self.states), np.arange(self.states)
        for k, value in enumerate(x):
            left = self.step(left, value)
            if k % 8 == 0 and len(left) > 1:
                left, back = np.unique(left, return_inverse=True)
                of = back[of]
        return left[of].tolist()

    def after(self, table, state):
        return table[state]

    def advance(self, x, state):
        """The positions, and the state after them."""
        import numpy as np

        now, out = np.array([state]), np.empty(len(x), np.int64)
        for k, value in enumerate(x):
            now = self.step(now, value)
            out[k] = now[0]
        return self.positions(out), int(now[0])


class Hysteresis(Finite):
    """States are -1, 0 or 1 and the bars since the last change, of which no more than ``min_hold`` matter."""

    def __init__(self, long_entry, long_exit, short_entry, short_exit, allow_short, min_hold):
        self.levels = long_entry, long_exit, short_entry, short_exit
        self.allow_short, self.hold = allow_short, min_hold
        self.states, self.start = 3 * (min_hold + 1), min_hold + 1

    def step(self, states, p):
        import numpy as np

        pos, held = states // (self.hold + 1) - 1, states % (self.hold + 1)
        on = np.minimum(held + 1, self.hold) + (pos + 1) * (self.hold + 1)
        if p != p:
            return on
        long_entry, long_exit, short_entry, short_exit = self.levels
        want = np.where((pos > 0) & (p < long_exit) | (pos < 0) & (p > short_exit), 0, pos)
        if self.allow_short and p <= short_entry:
            want = np.where(pos >= 0, -1, want)
        if p >= long_entry:
            want = np.where(pos <= 0, 1, want)
        return np.where((want != pos) & (held >= self.hold), (want + 1) * (self.hold + 1), on)

    def positions(self, states):
        return states // (self.hold + 1) - 1.0


class Fade(Finite):
    """States are -1, 0 and 1."""

    states, start = 3, 1

    def __init__(self, entry, exit):
        self.entry, self.exit = entry, exit

    def step(self, states, z):
        import numpy as np

        if z != z:
            return states
        into = 2 if z <= -self.entry else 0 if z >= self.entry else 1
        out = (states == 2) & (z >= -self.exit) | (states == 0) & (z <= self.exit)
        return np.where(states == 1, into, np.where(out, 1, states))

    def positions(self, states):
        return states - 1.0


class MinHold:
    """The state is (position, bars held up to ``bars``, wanted position), where positions are any numbers.

    At a block's beginning only two things matter: at which bar the position may change first, and whether what is wanted there is what is held.
    So the table has, for each bar that may be the first, what is wanted and the ends after a change there and after one at the next other wish.
    """

    def __init__(self, bars: int):
        self.bars, self.start = bars, [0.0, bars, 0.0]

    def table(self, x):
        lead = next((k for k, v in enumerate(x) if v == v), len(x))
        w, n = [], len(x) - lead
        for v in x[lead:]:
            w.append(float(v) if v == v else w[-1])
        other, end = [n] * n, [None] * n
        for k in range(n - 2, -1, -1):
            other[k] = k + 1 if w[k + 1] != w[k] else other[k + 1]
        for k in range(n - 1, -1, -1):
            j = k + 1 + self.bars
            if j < n and w[j] == w[k]:
                j = other[j]
            end[k] = end[j] if j < n else [w[k], min(n - 1 - k, self.bars)]
        first = range(min(self.bars + 1, n))
        return {"lead": lead, "n": n, "last": w[-1] if n else None, "first": [[w[k], end[k], end[other[k]] if other[k] < n else None] for k in first]}

    def after(self, table, state):
        pos, held, want = state
        if lead := table["lead"]:
            free = max(0, self.bars - held)
            pos, held = (want, min(lead - 1 - free, self.bars)) if want != pos and free < lead else (pos, min(held + lead, self.bars))
        free, n = max(0, self.bars - held), table["n"]
        if n:
            stay = [pos, min(held + n, self.bars)]
            if free < n:
                wish, changed, later = table["first"][free]
                stay = changed if wish != pos else later or stay
            pos, held, want = *stay, table["last"]
        return [pos, held, want]

    def advance(self, x, state):
        pos, held, want = state
        out = []
        for v in x:
            want = float(v) if v == v else want
            pos, held = (want, 0) if want != pos and held >= self.bars else (pos, min(held + 1, self.bars))
            out.append(pos)
        return out, [pos, held, want]


class Band:
    """The state is the position, any number.  It moves at the first target more than ``width`` away, and goes on from there.

    The first such target is one that is higher or lower than all before it in the block, so the table has these, with the ends that they lead to.
    """

    def __init__(self, width: float):
        self.width, self.start = width, 0.0

    def table(self, x):
        high, low, rises, falls, seen = -math.inf, math.inf, [], [], {}
        for k, v in enumerate(x):
            if v > high:
                rises.append([k, float(v)])
                high = v
            if v < low:
                falls.append([k, float(v)])
                low = v
        for k, _ in reversed(sorted(rises + falls)):
            if k not in seen:
                pos = float(x[k])
                for j in range(k + 1, len(x)):
                    if x[j] == x[j] and abs(x[j] - pos) > self.width:
                        pos = seen.get(j, float(x[j]))
                        if j in seen:
                            break
                seen[k] = pos
        return [[[*r, seen[r[0]]] for r in rows] for rows in (rises, falls)]

    def after(self, table, pos):
        rises, falls = table
        up = next((r for r in rises if r[1] - pos > self.width), None)
        down = next((r for r in falls if pos - r[1] > self.width), None)
        first = min((r for r in (up, down) if r), default=None)
        return first[2] if first else pos

    def advance(self, x, pos):
        out = []
        for v in x:
            if v == v and abs(v - pos) > self.width:
                pos = float(v)
            out.append(pos)
        return out, pos


def scan(rows: DataFrame, x: str | dict[str, str], out: dict[str, object], by: list[str] | None = None, order: str = "ts", days: int = DAYS) -> DataFrame:
    """Add the position of each machine of ``out`` (by its column), all in one pass over ``x`` (or over the column that ``x`` names for each).

    Rows without a key or a time have no place in a history and are left out.
    """
    import pandas as pd

    by, machines = by or ["symbol"], list(out.values())
    keep = [c for c in rows.columns if c not in out]
    reads = [x if isinstance(x, str) else x[name] for name in out]
    numbers = lambda b, c: b[c].to_numpy(dtype="float64", na_value=float("nan"))
    key = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    b = rows.select(*keep).withColumn("_block", block_of(order, days))

    def tables(group):
        group = group.sort_values(order, kind="stable")
        return pd.DataFrame({**{c: [group[c].iloc[0]] for c in [*by, "_block"]}, "_table": [json.dumps([m.table(numbers(group, c)) for m, c in zip(machines, reads, strict=True)])]})

    def starts(group):
        group, states, found = group.sort_values("_block"), [m.start for m in machines], []
        for t in group["_table"]:
            found.append(json.dumps(states))
            states = [m.after(own, s) for m, own, s in zip(machines, json.loads(t), states, strict=True)]
        group["_start"] = found
        return group[[*by, "_block", "_start"]]

    def replay(group):
        group = group.sort_values(order, kind="stable")
        for name, m, c, s in zip(out, machines, reads, json.loads(group["_start"].iloc[0]), strict=True):
            group[name] = m.advance(numbers(group, c), s)[0]
        return group[[*keep, *out]]

    # Tables and replay read the same columns, so that Spark shuffles the rows once for both.
    made = b.groupBy(*by, "_block").applyInPandas(tables, f"{key}, _block bigint, _table string")
    begun = made.groupBy(*by).applyInPandas(starts, f"{key}, _block bigint, _start string")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return b.join(begun, [*by, "_block"]).groupBy(*by, "_block").applyInPandas(replay, f"{fields}, " + ", ".join(f"`{c}` double" for c in out))


def hysteresis(rows: DataFrame, x: str, out: str = "pos", long_entry=0.56, long_exit=0.50, short_entry=0.44, short_exit=0.50, allow_short=True, min_hold=6) -> DataFrame:
    """From probabilities to -1, 0 or 1 with separate entry and exit levels.

    A missing probability holds.  Nothing changes before ``min_hold`` bars have passed since the last change, or since the start.
    """
    return scan(rows, x, {out: Hysteresis(long_entry, long_exit, short_entry, short_exit, allow_short, min_hold)})


def min_hold(rows: DataFrame, x: str, out: str = "pos", bars: int = 6) -> DataFrame:
    """Follow a wanted position, at most one change in so many bars; the first may come at once."""
    return scan(rows, x, {out: MinHold(bars)})


def band(rows: DataFrame, x: str, out: str = "pos", width: float = 0.1, by=None) -> DataFrame:
    """Move to a target only when it is more than ``width`` away."""
    if width <= 0:
        return rows.withColumn(out, rows[x])
    return scan(rows, x, {out: Band(width)}, by)


def fade(rows: DataFrame, x: str, out: str = "pos", entry: float = 2.0, exit: float = 0.5, by=None) -> DataFrame:
    """Against a z-score: in at ``entry``, out at ``exit``, never both on one bar."""
    return scan(rows, x, {out: Fade(entry, exit)}, by)


def _through(kept: float):
    """What a run with c values and the sum b makes of a mean of which ``kept`` stays at each value."""
    return lambda y, run: F.pow(F.lit(kept), run["c"]) * (y + run["b"])


def means(rows: DataFrame, weights: dict[str, tuple[str, float]], by: list[str] | None = None, order: str = "ts") -> DataFrame:
    """Add recursive means: ``out`` -> (x, a) is y = (1 - a) * y + a * x, from the first x on; rows have their ``_block``.

    A mean goes through a run of rows as y -> A*y + B.  Within a run, B is a prefix sum of x weighted by powers of 1/(1 - a), so a run is only as long
    as these powers fit a double.  The pairs (A, B) of earlier runs are folded, as many as have not decayed to nothing.
    A missing x leaves the mean as it is, and the mean is null before the first x.
    """
    by = by or ["symbol"]
    most = max([-math.log1p(-a) for _, a in weights.values() if a < 1] or [1.0])
    run_rows = max(1, min(256, int(300 / most)))
    block = [*by, "_block"]
    out = rows.withColumn("_run", F.floor((F.row_number().over(Window.partitionBy(*block).orderBy(order)) - 1) / F.lit(run_rows)))
    w = Window.partitionBy(*block, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for k, (x, a) in enumerate(weights.values()):
        if a >= 1:
            raise ValueError("a weight of 1 is no mean")
        out = out.withColumn(f"_c{k}", F.count(x).over(w))  # values so far, hence powers of 1 - a
        out = out.withColumn(f"_f{k}", F.first(x, ignorenulls=True).over(w))
        out = out.withColumn(f"_b{k}", F.sum(F.lit(a) * F.col(x) * F.pow(F.lit(1 / (1 - a)), F.col(f"_c{k}"))).over(w))
    ends = [F.struct(F.max(f"_c{k}").alias("c"), F.max_by(f"_b{k}", F.when(F.col(f"_b{k}").isNotNull(), F.col(order))).alias("b"), F.min_by(x, F.when(F.col(x).isNotNull(), F.col(order))).alias("x")).alias(f"_e{k}") for k, (x, _) in enumerate(weights.values())]
    runs = out.groupBy(*block, "_run").agg(*ends)
    all_before = Window.partitionBy(*by).orderBy("_block", "_run").rowsBetween(Window.unboundedPreceding, 0)
    for k, (_, a) in enumerate(weights.values()):
        # The place of a run on the scale of decay; what is 745 further back has decayed to less than any double.
        runs = runs.withColumn(f"_l{k}", F.sum(F.col(f"_e{k}.c") * F.lit(-math.log1p(-a))).over(all_before))
        runs = runs.withColumn(f"_x{k}", F.first(f"_e{k}.x", ignorenulls=True).over(all_before))
    for k, (_, a) in enumerate(weights.values()):
        near = Window.partitionBy(*by).orderBy(f"_l{k}").rangeBetween(-760, 0)
        pairs = F.array_sort(F.filter(F.collect_list(F.struct(F.col(f"_l{k}").alias("l"), F.col(f"_e{k}.c").alias("c"), F.col(f"_e{k}.b").alias("b"))).over(near), lambda p: p["c"] > 0))
        runs = runs.withColumn(f"_y{k}", F.aggregate(pairs, F.col(f"_x{k}"), _through(1 - a)))
    ordered = Window.partitionBy(*by).orderBy("_block", "_run")
    begin = runs.select(*block, "_run", *[F.lag(f"_y{k}").over(ordered).alias(f"_y{k}") for k in range(len(weights))])
    found = out.join(begin, [*block, "_run"])
    for k, (name, (_, a)) in enumerate(weights.items()):
        # Without an earlier run it begins with the first value, which is null before there is one.
        found = found.withColumn(name, F.pow(F.lit(1 - a), F.col(f"_c{k}")) * (F.coalesce(f"_y{k}", f"_f{k}") + F.coalesce(f"_b{k}", F.lit(0.0))))
    return found.drop("_run", *[f"_{c}{k}" for c in "bcfy" for k in range(len(weights))])
