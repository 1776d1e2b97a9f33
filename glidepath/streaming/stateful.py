"""Track enrichment on a stream: the previous reports of an aircraft as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = ("icao string, snapshot_ts timestamp, seg_start_ts timestamp, dt_s bigint, dist_to_apt_nm double, closure_kt double,"
          " turn_deg double, vrate_fpm double, inbound_flag boolean")
STATE = "us bigint, seg_start bigint, alt double, dist double, track double, step_1 int, step_2 int"
#: A waiting report, as a bucket holds it: microseconds, values (NaN for null), on the ground (-1 for null).
WAITING = np.dtype([("us", "i8"), ("alt", "f8"), ("dist", "f8"), ("track", "f8"), ("err", "f8"), ("vrate", "f8"), ("grounded", "i1")])

#: Reports that a release steps over at once.
STEP = 1 << 16


class TrackState(StatefulProcessor):
    """Emits reports in time order once the watermark has passed them.

    Waiting reports lie in buckets of `bucket_s` by time: a batch touches each bucket of its reports once, and a release reads only the
    buckets that the watermark has reached, however long an aircraft's waiting list is. Every call of the state and every step has a fixed
    cost, so buckets hold many reports and a release steps over up to `STEP` reports at once. Of the past only the last report's values
    stay. An aircraft that falls silent is dropped from the state `idle_ms` after its last report.
    """

    def __init__(self, max_gap_s: int = 180, vrate_gap_s: int = 600, max_closure_kt: float = 700.0, inbound_err: float = 70.0,
                 idle_ms: int = 3_600_000, bucket_s: int = 900):
        self.max_gap_s, self.vrate_gap_s, self.max_closure, self.inbound_err = max_gap_s, vrate_gap_s, max_closure_kt, inbound_err
        self.idle_ms, self.bucket_us = idle_ms, bucket_s * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", STATE)
        self.waiting = handle.getMapState("waiting", "bucket bigint", "reports binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        waiting = self._waiting()
        for pdf in rows:
            new = _packed(pdf)
            buckets = new["us"] // self.bucket_us
            order = np.argsort(buckets, kind="stable")
            edges = np.flatnonzero(np.diff(buckets[order], prepend=buckets[order[0]] - 1, append=buckets[order[-1]] + 1))
            for a, b in zip(edges, edges[1:]):
                bucket = int(buckets[order[a]])
                held = self.waiting.getValue((bucket,))[0] if bucket in waiting else b""
                self.waiting.updateValue((bucket,), (bytes(held) + new[order[a:b]].tobytes(),))
                waiting.add(bucket)
        yield from self._release(key, mark, waiting)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        yield from self._release(key, mark, self._waiting())
        if self.last.exists() and not self.waiting.exists() and mark >= self.last.get()[0] // 1000 + self.idle_ms:
            self.last.clear()

    def _waiting(self) -> set[int]:
        """The buckets that hold reports."""
        return {k[0] for k in self.waiting.keys()}  # noqa: SIM118

    def _release(self, key, mark: int, waiting: set[int]) -> Iterator[pd.DataFrame]:
        """Reports up to the watermark, about `STEP` at a time; a timer for the first one that stays."""
        passed = mark * 1000
        gathered, size, first = [], 0, None
        for bucket in sorted(waiting):
            if bucket * self.bucket_us > passed:
                first = bucket * self.bucket_us
                break
            held = np.frombuffer(bytes(self.waiting.getValue((bucket,))[0]), dtype=WAITING)
            held = held[np.argsort(held["us"], kind="stable")]
            ready, stays = held[held["us"] <= passed], held[held["us"] > passed]
            if len(ready):
                gathered.append(ready)
                size += len(ready)
            if len(stays):
                if len(ready):
                    self.waiting.updateValue((bucket,), (stays.tobytes(),))
                first = int(stays["us"][0])
                break
            self.waiting.removeKey((bucket,))
            if size >= STEP:
                yield self._step(key, np.concatenate(gathered))
                gathered, size = [], 0
        if gathered:
            yield self._step(key, np.concatenate(gathered))
        if first is not None:
            self.handle.registerTimer(max(first // 1000, mark) + 1)
        elif waiting and self.last.exists():
            self.handle.registerTimer(max(self.last.get()[0] // 1000 + self.idle_ms, mark + 1))

    def _step(self, key, w: np.ndarray) -> pd.DataFrame:
        """Reports in time order after the last one: output rows, and the new state."""
        prev = self.last.get() if self.last.exists() else None
        none = np.nan
        before = prev or (0, 0, none, none, none, 0, 0)
        us = w["us"]

        def lagged(name: str, first) -> np.ndarray:
            return np.concatenate(([none if first is None else first], w[name][:-1]))

        gap = (us - np.concatenate(([before[0]], us[:-1]))) // 1_000_000
        known = np.ones(len(w), bool)
        known[0] = prev is not None
        same = known & (gap >= 1) & (gap <= self.max_gap_s)
        at = np.maximum.accumulate(np.where(same, -1, np.arange(len(w))))
        start = np.where(at < 0, before[1], us[np.maximum(at, 0)])
        with np.errstate(invalid="ignore", divide="ignore"):
            nearer = lagged("dist", before[3]) - w["dist"]
            closure = np.where(same, nearer / gap * 3600, none)
            closure[np.abs(closure) > self.max_closure] = none
            swing = np.abs(w["track"] - lagged("track", before[4]))
            turn = np.where(same, np.minimum(swing, 360 - swing), none)
            near = known & (gap >= 1) & (gap <= self.vrate_gap_s)
            climb = np.where(near, (w["alt"] - lagged("alt", before[2])) / gap * 60.0, none)
            step = (same & (nearer > 0)).astype(np.int64)
        vrate = np.where(np.isnan(w["vrate"]), climb, w["vrate"])
        steps = np.concatenate(([before[6], before[5]], step))  # the state has no second step if the first one began a segment
        joined = np.concatenate(([True], same[:-1]))
        count = step + np.where(same, steps[1:-1] + np.where(joined, steps[:-2], 0), 0)
        # as SQL: false if any condition is, else unknown if any is
        rules = [(w["err"] < self.inbound_err, np.isnan(w["err"])), ((w["alt"] >= 500) & (w["alt"] <= 40000), np.isnan(w["alt"])),
                 (w["grounded"] == 0, w["grounded"] < 0), (count >= 2, np.zeros(len(w), bool))]
        inbound = np.logical_and.reduce([ok for ok, _ in rules]).astype(object)
        unknown = np.logical_or.reduce([null for _, null in rules]) & ~np.logical_or.reduce([~ok & ~null for ok, null in rules])
        inbound[unknown] = None
        self.last.update((int(us[-1]), int(start[-1]), *(None if np.isnan(w[c][-1]) else float(w[c][-1]) for c in ("alt", "dist", "track")),
                          int(step[-1]), int(steps[-2]) if same[-1] else 0))
        return pd.DataFrame({
            "icao": key[0], "snapshot_ts": us.astype("datetime64[us]"), "seg_start_ts": start.astype("datetime64[us]"),
            "dt_s": pd.Series(gap).where(same).astype("Int64"), "dist_to_apt_nm": w["dist"], "closure_kt": closure, "turn_deg": turn,
            "vrate_fpm": vrate, "inbound_flag": inbound})


def _packed(pdf: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(pdf), dtype=WAITING)
    out["us"] = pdf["snapshot_ts"].to_numpy().astype("datetime64[us]").astype("i8")
    for name, column in (("alt", "alt_ft"), ("dist", "dist_to_apt_nm"), ("track", "track_deg"), ("err", "heading_err_deg"), ("vrate", "vertical_rate_fpm")):
        out[name] = pd.to_numeric(pdf[column]).to_numpy(dtype="f8", na_value=np.nan)
    flags = pdf["is_grounded"]
    out["grounded"] = np.where(flags.isna(), -1, flags.fillna(False).astype(bool).astype("i1"))
    return out


def stateful_tracks(silver: DataFrame, watermark: str = "15 minutes", **params) -> DataFrame:
    """Enriched reports of a Silver stream. Needs the RocksDB state store provider."""
    return (
        silver.where("has_position").withWatermark("snapshot_ts", watermark).groupBy("icao")
        .transformWithStateInPandas(TrackState(**params), OUTPUT, outputMode="Append", timeMode="EventTime")
    )
