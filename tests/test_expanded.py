"""Pairs of rows from pairs of classes, in blocks (findings 1, 3, 4, 6, 8)."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from touchline.operators import entity, joins


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_lose_and_repeat_no_pair(spark, block):
    rnd = random.Random(block)
    data = [(i, rnd.choice("xxxyz"), i % 3) for i in range(60)]
    linked = {("x", "x"), ("x", "y"), ("z", "z")}
    members = spark.createDataFrame(data, "id int, c string, v int")
    pairs = spark.createDataFrame([(*p, i) for i, p in enumerate(sorted(linked))], "a_c string, b_c string, w int")
    got = sorted((r.a_id, r.b_id, r.a_v, r.b_v) for r in joins.expanded(pairs, members, ["c"], "id", ["v"], block).collect())
    want = sorted((i, j, v, w) for (i, c, v), (j, e, w) in itertools.combinations(data, 2) if (c, e) in linked or (e, c) in linked)
    assert got == want


def test_different_names_are_compared_once(spark):
    data = [(i, "Solar Stars", "WA") for i in range(300)] + [(i, "Solar Stars FC", "WA") for i in range(300, 320)]
    df = spark.createDataFrame(data, "id int, name string, state string")
    got = entity.duplicate_pairs(df, "id", "name", [F.col("state")], 0.4)
    assert got.count() == 320 * 319 // 2
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "levenshtein" not in plan  # compared before the rows are paired


def test_repeated_tokens_lose_no_pair(spark):
    names = ["a a a a a b c d e f", "a b c d e g", "a a a a a b c d e"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    want = {(r.a_id, r.b_id) for r in entity.duplicate_pairs(df, "id", "name", [F.lit(1)], 0.0).where("similarity >= 0.6").collect()}
    assert {(r.a_id, r.b_id) for r in entity.duplicate_pairs(df, "id", "name", [F.lit(1)], 0.6).collect()} == want


def test_containing_keeps_copies_of_texts(spark):
    texts = spark.createDataFrame([(1, "Blue Bolt"), (2, "blue bolt"), (3, "blue bolt"), (4, None)], "id int, t string")
    wanted = spark.createDataFrame([("bolt",), ("BOLT",), ("b",), ("",)], "n string")
    got = sorted((r.id, r.n) for r in joins.containing(texts, "t", wanted, "n").collect())
    assert got == sorted((i, n) for i in (1, 2, 3) for n in ("bolt", "BOLT", "b"))
