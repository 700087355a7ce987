"""Streams and versioned tables against their batch forms, whatever the cuts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import cdc, windows
from touchline.plans.live import _end
from touchline.sources.versioned import VersionedTable
from touchline.streaming import stateful, streams

DAY = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("cuts", [1, 3])
def test_snapshot_diff_stream(spark, tmp_path, cuts):
    rnd = random.Random(4)
    data = [(g, DAY + dt.timedelta(days=d), f"p{p}", rnd.choice([None, "", "7", "9"]), rnd.choice(["F", "M", None])) for g in ("a", "b", None) for d in (0, 3, 4, 9) for p in range(6) if rnd.random() < 0.7]
    df = spark.createDataFrame(data, "club string, at timestamp, player string, jersey string, position string").where("club IS NOT NULL")
    stream = streams.in_cuts(df, f"{tmp_path}/in", cuts, end=_end(df, "at"))
    got = streams.run_available(stateful.snapshot_diff_stream(stream, ["club"], "at", "player", ["jersey", "position"], "400 days"), f"{tmp_path}/out", "append", stateful.STORE)
    want = cdc.snapshot_diff(df, ["club"], "at", "player", ["jersey", "position"])
    assert rows(got.select(*want.columns)) == rows(want) and want.count() > 10


def test_streak_stream_takes_late_rows(spark, tmp_path):
    """Rows come in any order; some are folded before the last ones come."""
    rnd = random.Random(6)
    data = [(i, rnd.choice("abc"), DAY + dt.timedelta(hours=i), rnd.random() < 0.6) for i in range(80)]
    order = sorted(data, key=lambda r: r[0] + rnd.randrange(12))  # late by less than half a day
    for k in range(4):
        spark.createDataFrame(order[k * 20 : k * 20 + 20], "id long, k string, t timestamp, bad boolean").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id long, k string, t timestamp, bad boolean").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = streams.run_available(stateful.streak_stream(stream, "k", "t", "bad", "id", "12 hours"), f"{tmp_path}/out", "update", stateful.STORE, numbered=True)
    want = windows.failure_streak(spark.createDataFrame(data, "id long, k string, t timestamp, bad boolean"), "k", "t", "id", F.col("bad"))
    assert rows(got.groupBy("key").agg(F.max_by("streak", "batch"))) == rows(want)


def test_versions_swap_under_open_readers(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.latest() is None
    with pytest.raises(FileNotFoundError):
        table.read()
    table.replace(spark.range(3))
    before = table.read()
    table.replace(spark.range(10, 15))
    assert rows(before) == [(0,), (1,), (2,)] and table.read().count() == 5 and table.read(0).count() == 3
    late = table.write(spark.range(1))
    with pytest.raises(FileExistsError):  # another writer came first
        table.commit(late, "id bigint", 0)
    assert table.numbers() == [0, 1] and table.read().count() == 5
    table.forget()
    assert table.numbers() == [1] and table.read().count() == 5
    table.replace(spark.range(0))
    assert table.read().count() == 0


def test_repeated_and_lost_batches_count_once(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    add = lambda old, batch: batch if old is None else old.unionByName(batch)
    apply = table.upsert_batch(add, "s")
    apply(spark.range(2), 0)
    apply(spark.range(2), 0)
    table.write(spark.range(100))  # a writer that died between its files and its commit
    apply(spark.range(5, 6), 1)
    apply(spark.range(2), 0)
    table.upsert_batch(add, "other")(spark.range(9, 10), 0)
    assert rows(table.read()) == [(0,), (1,), (5,), (9,)] and table.latest()["batches"] == {"s": 1, "other": 0}


def test_trailing_counts(spark, tmp_path):
    rnd = random.Random(9)
    data = [(DAY + dt.timedelta(hours=rnd.randrange(24 * 120)), rnd.choice("xy")) for _ in range(200)]
    df = spark.createDataFrame(data, "t timestamp, k string")
    stream = streams.in_cuts(df, f"{tmp_path}/in", 2, end=_end(df, "t"))
    got = {(r.width, r.until, r.kind): r.n for r in streams.run_available(stateful.trailing_counts(stream, "t", "k", "200 days"), f"{tmp_path}/out", "append").where("kind IS NOT NULL").collect()}
    for width, days in stateful.WIDTHS.items():
        for d in (1, 10, 60, 125, 200):
            until = DAY + dt.timedelta(days=d)
            for k in "xy":
                n = sum(kind == k and until - dt.timedelta(days=days) <= t < until for t, kind in data)
                assert got.get((width, until, k), 0) == n


def test_cuts_of_many_files_are_whole_batches(spark, tmp_path):
    df = spark.range(100).repartition(3)
    seen = []
    stream = streams.in_cuts(df, f"{tmp_path}/in", 2, end=spark.createDataFrame([(1000,)], "id long"), file_rows=7)
    streams.run_batches(stream, lambda batch, _: seen.append({r.id for r in batch.collect()}), f"{tmp_path}/state")
    assert len(seen) == 3 and seen[2] == {1000} and not seen[0] & seen[1] and seen[0] | seen[1] == set(range(100))
    assert len(spark.read.parquet(f"{tmp_path}/in/batch=0").inputFiles()) > 1
