"""Positions of a recursive rule over a stream of bars: the same as over the whole history, whatever the order in which rows arrive.

A symbol's state is that of its machine and the rows that have come but aren't final.  A row is final when the watermark has passed it: all rows before it
have come or are too late.  Final rows go through the machine in the order of time; a timer wakes a symbol that gets no more rows.  Rows later than the watermark
allows are dropped by Spark before they get here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

_OUT = "symbol string, ts timestamp, pos double"


def stream_positions(rows: DataFrame, x: str, machine, late: str = "2 hours") -> DataFrame:
    """(symbol, ts, pos) of a stream (symbol, ts, x): each row once, when it is final.

    ``machine`` is any of :mod:`edgeprobe.operators.scans`.  State is one symbol's machine and its rows within ``late`` of the newest.
    """

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held, waiting = json.loads(state.get[0]) if state.exists else (machine.start, [])
        if not state.hasTimedOut:
            for b in batches:
                at = (b["ts"].dt.tz_localize(None).astype("datetime64[us]")).astype("int64")
                values = b[x].to_numpy(dtype="float64", na_value=float("nan"))
                waiting += [[int(t), None if v != v else float(v)] for t, v in zip(at, values, strict=True)]
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: r[0])
        final = [r for r in waiting if r[0] < mark]
        waiting = waiting[len(final) :]
        if final:
            pos, held = machine.advance([float("nan") if v is None else v for _, v in final], held)
            yield pd.DataFrame({"symbol": key[0], "ts": pd.to_datetime([t for t, _ in final], unit="us"), "pos": [float(p) for p in pos]})
        state.update((json.dumps([held, waiting]),))
        if waiting:
            state.setTimeoutTimestamp(max(mark // 1000, waiting[0][0] // 1000) + 1)

    marked = rows.select("symbol", "ts", x).withWatermark("ts", late)
    return marked.groupBy("symbol").applyInPandasWithState(advance, _OUT, "state string", "append", "EventTimeTimeout")
