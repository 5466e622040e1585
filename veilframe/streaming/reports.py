"""Report admission over a stream: the last admitted time of each key, or the memory of each server instance, is its state, and leaves with the window."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.events import HOUR_MS, PAGE_REPORTS, Admission


def admitted_stream(reports: DataFrame, window_ms: int = HOUR_MS, lateness: str = "10 minutes") -> DataFrame:
    """(key, ts_ms, admitted) of a stream (key string, ts timestamp). Within a batch a key's reports are taken in time; reports later than the watermark are dropped by Spark's rule."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        times = sorted(int(t) for p in parts for t in p["ts"].astype("datetime64[ms]").astype("int64"))
        out = []
        for t in times:
            ok = last is None or t - last >= window_ms
            last = t if ok else last
            out.append((key[0], t, ok))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + window_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "ts_ms", "admitted"])

    return reports.withWatermark("ts", lateness).groupBy("key").applyInPandasWithState(run, "key string, ts_ms long, admitted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def admit_reports_stream(reports: DataFrame, window_ms: int = HOUR_MS, budget: int = PAGE_REPORTS, lateness: str = "10 minutes") -> DataFrame:
    """(instance, seq, key, ts_ms, admitted) of a stream (instance string, seq long, key string, ts timestamp, draws boolean), by both rules. An instance's state holds the keys of one window and the day's count; within a batch its reports are taken in time."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = (json.loads(state.get[0]), *state.get[1:]) if state.exists else ({}, -1, 0)
        rule = Admission(window_ms, budget, *kept)
        rows = pd.concat(list(parts))
        rows["ts_ms"] = rows["ts"].astype("datetime64[ms]").astype("int64")
        rows = rows.sort_values(["ts_ms", "seq"])
        rows["admitted"] = [rule.take(k, int(t), bool(d)) for k, t, d in zip(rows["key"], rows["ts_ms"], rows["draws"], strict=True)]
        last = int(rows["ts_ms"].iloc[-1])
        rule.forget(last)
        state.update((json.dumps(rule.sent), rule.day, rule.spent))
        state.setTimeoutTimestamp(max(last + max(window_ms, 86_400_000), state.getCurrentWatermarkMs() + 1))
        yield rows[["instance", "seq", "key", "ts_ms", "admitted"]]

    out = "instance string, seq long, key string, ts_ms long, admitted boolean"
    return reports.withWatermark("ts", lateness).groupBy("instance").applyInPandasWithState(run, out, "sent string, day long, spent long", "append", GroupStateTimeout.EventTimeTimeout)
