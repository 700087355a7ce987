"""Streams with keyed state: snapshot diffs, failure streaks, run outcomes, trailing windows.

All of them hold rows until the watermark has passed, so that the order of arrival
within ``late`` does not matter, and give what the batch operators give. Rows later
than that are dropped by Spark and counted in the query's progress.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Keyed state with timers needs this store.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: A row of this time moves the watermark past all others, where a stream is known to be at its end.
END = "2250-01-01 00:00:00"


class _SnapshotDiff(StatefulProcessor):
    """The last snapshot as a map, open ones by time; an open one is compared when its timer fires."""

    def __init__(self, groups: int, fields: list[str]):
        self.groups, self.fields = groups, fields

    def init(self, handle: StatefulProcessorHandle) -> None:
        values = ", ".join(f"v{i} string" for i in range(len(self.fields)))
        self.last = handle.getMapState("last", "entity string", values)
        self.seen = handle.getValueState("seen", "at long")
        self.open = handle.getMapState("open", "at long, entity string", values)
        self.handle = handle

    def _rows(self, frame: pd.DataFrame) -> Iterator[tuple]:
        """Time, entity and values; no value and an empty one are the same."""
        values = [frame[f"v{i}"].fillna("") for i in range(len(self.fields))]
        yield from zip(frame["at_ms"], frame["entity"], zip(*values, strict=True), strict=True)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        for at, entity, values in self._rows(initialState):
            self.last.updateValue((entity,), values)
            self.seen.update((int(at),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, entity, values in self._rows(frame):
                if not self.open.containsKey((int(at), entity)):
                    self.open.updateValue((int(at), entity), values)
            for at in set(frame["at_ms"]):
                self.handle.registerTimer(int(at))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        now = {k[1]: tuple(v) for k, v in self.open.iterator() if k[0] == at}
        before = {k[0]: tuple(v) for k, v in self.last.iterator()}
        out = []
        if self.seen.exists():
            for e in sorted({*now, *before}):
                if e not in before:
                    out.append((e, "added", None, None))
                elif e not in now:
                    out.append((e, "removed", None, None))
                else:
                    out += [(e, f"{f}_changed", a, b) for f, a, b in zip(self.fields, before[e], now[e], strict=True) if a != b]
        self.last.clear()
        for e, values in now.items():
            self.last.updateValue((e,), values)
            self.open.removeKey((at, e))
        self.seen.update((at,))
        if out:
            frame = pd.DataFrame(out, columns=["entity", "diff_type", "from_value", "to_value"])
            for i in range(self.groups):
                frame[f"g{i}"] = key[i]
            frame["at_ms"] = at
            yield frame[[*(f"g{i}" for i in range(self.groups)), "at_ms", "entity", "diff_type", "from_value", "to_value"]]

    def close(self) -> None:
        pass


def snapshot_diff_stream(snapshots: DataFrame, group: list[str], at: str, entity: str, fields: list[str], late: str = "0 seconds", initial: DataFrame | None = None) -> DataFrame:
    """CDC-01: the changes of ``cdc.snapshot_diff`` from a stream of snapshot rows.

    ``at`` is a timestamp; a snapshot is compared with the one before it in time when
    the watermark has passed it. ``initial`` is the last stored snapshot of each group (the
    same columns), the state to begin with. One group's snapshots are held at a time.
    """
    types = {f.name: f.dataType.simpleString() for f in snapshots.schema}

    def shaped(df: DataFrame) -> DataFrame:
        named = [F.col(g).alias(f"g{i}") for i, g in enumerate(group)]
        values = [F.col(f).cast("string").alias(f"v{i}") for i, f in enumerate(fields)]
        return df.select(*named, F.col(at).alias("at"), F.unix_millis(F.col(at).cast("timestamp")).alias("at_ms"), F.col(entity).cast("string").alias("entity"), *values)

    keys = [f"g{i}" for i in range(len(group))]
    out = ", ".join([*(f"{k} {types[g]}" for k, g in zip(keys, group, strict=True)), "at_ms long, entity string, diff_type string, from_value string, to_value string"])
    begin = shaped(initial).drop("at").groupBy(*keys) if initial is not None else None
    changes = shaped(snapshots.withWatermark(at, late)).groupBy(*keys).transformWithStateInPandas(_SnapshotDiff(len(group), fields), out, "append", "eventTime", initialState=begin)
    return changes.select(*(F.col(k).alias(g) for k, g in zip(keys, group, strict=True)), F.timestamp_millis("at_ms").cast(types[at]).alias(at), F.col("entity").alias(entity), "diff_type", "from_value", "to_value")


class _Streak(StatefulProcessor):
    """Rows within the watermark are kept and sorted anew; older ones are folded into one count.

    One timer is set while any row is kept; when it fires, all that the watermark has passed are folded.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "ms long, id long, failed boolean")
        self.folded = handle.getValueState("folded", "streak long")
        self.handle = handle

    @staticmethod
    def _run(streak: int, rows: list) -> int:
        for row in rows:
            streak = streak + 1 if row[2] else 0
        return streak

    def _before(self) -> int:
        return self.folded.get()[0] if self.folded.exists() else 0

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = [row for frame in rows for row in zip(frame["at_us"].tolist(), frame["row_id"].tolist(), map(bool, frame["has_failed"]), strict=True)]
        known = [tuple(r) for r in self.recent.get()] if self.recent.exists() else []
        self.recent.appendList(fresh)
        kept = sorted(known + fresh)
        if not known:
            self.handle.registerTimer(kept[0][0] // 1000)
        yield pd.DataFrame({"key": [str(key[0])], "streak": [self._run(self._before(), kept)], "last_us": [kept[-1][0]]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        kept = sorted(tuple(r) for r in self.recent.get())
        done = [r for r in kept if r[0] // 1000 <= until]
        left = kept[len(done) :]
        if done:
            self.folded.update((self._run(self._before(), done),))
            self.recent.clear()
            if left:
                self.recent.put(left)
        if left:
            self.handle.registerTimer(left[0][0] // 1000)
        yield from ()

    def close(self) -> None:
        pass


def streak_stream(events: DataFrame, key: str, time: str, failed: str, order: str, late: str = "1 day") -> DataFrame:
    """ST-05: ``key, streak, last_us`` after each batch for the keys it touched: failures since the last success.

    Whatever the order of arrival within ``late``; rows of one time are ordered by
    ``order``. The last row of a key is its present streak.
    """
    rows = events.withWatermark(time, late).select(F.col(key).alias("of_key"), F.col(time).alias("at"), F.unix_micros(F.col(time).cast("timestamp")).alias("at_us"), F.col(order).cast("long").alias("row_id"), F.col(failed).alias("has_failed"))
    return rows.groupBy("of_key").transformWithStateInPandas(_Streak(), "key string, streak long, last_us long", "update", "eventTime")


def run_outcomes(starts: DataFrame, finishes: DataFrame, run: str, started: str, finished: str, within: str, late: str = "1 hour") -> DataFrame:
    """ST-08: each start with its finish, if one comes within ``within``; else it comes out unfinished when that time is over.

    A stream-stream outer join: both sides are kept only as long as the interval and
    the watermarks need.
    """
    s = starts.withWatermark(started, late).withColumnRenamed(run, "_srun")
    f = finishes.withWatermark(finished, late).withColumnRenamed(run, "_frun")
    on = (F.col("_srun") == F.col("_frun")) & (F.col(finished) >= F.col(started)) & (F.col(finished) <= F.col(started) + F.expr(f"INTERVAL {within}"))
    return s.join(f, on, "left_outer").withColumnRenamed("_srun", run).drop("_frun")


#: Days of the trailing windows (fixed values).
WIDTHS = {"24h": 1, "7d": 7, "30d": 30, "90d": 90}


def trailing_counts(events: DataFrame, time: str, kind: str, late: str = "1 day", widths: dict[str, int] = WIDTHS) -> DataFrame:
    """ST-03: ``width, until, kind, n``: counts of the days before each midnight, for every width with any.

    Panes of a day are counted once; one chained window of the longest width sums them
    for all widths, so a row of the log is touched once and state holds panes.
    """
    panes = events.withWatermark(time, late).groupBy(F.window(time, "1 day").alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"))
    timed = panes.select(F.window_time("w").alias("at"), "kind", "n")
    timed = timed.withColumn("w", F.window("at", f"{max(widths.values())} days", "1 day"))
    within = lambda days: F.sum(F.when(F.col("at") >= F.col("w.end") - F.make_interval(days=F.lit(days)), F.col("n")))
    summed = timed.groupBy("w", "kind").agg(*(within(days).alias(f"n{i}") for i, days in enumerate(widths.values())))
    each = F.array(*(F.struct(F.lit(name).alias("width"), F.col(f"n{i}").alias("n")) for i, name in enumerate(widths)))
    rows = summed.select(F.col("w.end").alias("until"), "kind", F.explode(each).alias("c"))
    return rows.select("c.width", "until", "kind", "c.n").where("n IS NOT NULL")
