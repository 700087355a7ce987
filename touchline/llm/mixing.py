"""Mixing sources to target weights over a domain-language-source tree.

Weights go down the tree: a node's share of its parent's budget is its weight
over the sum of its siblings' weights. A leaf offers its tokens times the epochs
allowed. What a node cannot fill goes to its siblings first, in proportion to
their weights and as far as they can take it, and only what a whole subtree
cannot fill goes up to the siblings of its parent.

A leaf's budget is then met by a prefix of its tokens in the seeded order of its
epochs: every epoch has an order of its own, full epochs are taken whole, and the
last one is cut inside the document that reaches the budget. ``taken_tokens`` are
a document's tokens within the prefix; ``copies`` counts the cut document as taken,
for those who keep whole documents. Order and cut need no task
that holds a leaf: documents fall into ranges of their random key, tokens are
summed by (leaf, range), running sums over ranges find the range with the cut,
and only that range is ordered row by row.

``n_tokens`` counts words ``[^\\x20\\x09-\\x0D]+``; null and empty texts have none
and are never taken. Null domain, language and source make nodes of their own.
Rows with the same id are told apart by text. Nothing to take, or a budget of 0,
gives ``copies`` 0 everywhere. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast

LEVELS = ("domain", "lang", "source")
#: Tokens that one range of keys should hold.
RANGE_TOKENS = 1 << 22


def fill(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """Split ``budget`` by weight among ``(weight, capacity)``; shortages go to the others."""
    given = [0.0] * len(children)
    open_, left = [i for i, (w, c) in enumerate(children) if w > 0 and c > 0], budget
    while open_ and left > 1e-9:
        weight = sum(children[i][0] for i in open_)
        short = [i for i in open_ if children[i][1] - given[i] <= left * children[i][0] / weight]
        if not short:
            for i in open_:
                given[i] += left * children[i][0] / weight
            return given
        spent = 0.0
        for i in short:
            spent += children[i][1] - given[i]
            given[i] = children[i][1]
        left -= spent
        open_ = [i for i in open_ if i not in set(short)]
    return given


def allocate(budget: float, capacity: dict[tuple, float], weight: Callable[[tuple], float]) -> dict[tuple, float]:
    """Budget of each leaf. ``capacity`` by leaf path, ``weight`` of a path's last step."""
    size: dict[tuple, float] = {}
    children: dict[tuple, list[tuple]] = {}
    for leaf, room in capacity.items():
        for depth in range(len(leaf) + 1):
            path = leaf[:depth]
            if path not in size and depth:
                children.setdefault(path[:-1], []).append(path)
            size[path] = size.get(path, 0.0) + room
    out: dict[tuple, float] = {}

    def down(path: tuple, amount: float) -> None:
        below = sorted(children.get(path, ()), key=repr)
        if not below:
            out[path] = amount
            return
        for child, part in zip(below, fill(amount, [(weight(c), size[c]) for c in below]), strict=True):
            down(child, part)

    if capacity:
        down((), min(budget, size[()]))
    return out


def _key(seed: int) -> Column:
    """A uniform key of the row in [0, 2**31), another one for each epoch."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col("epoch"), F.col("doc_id"), F.col("text_hash")), F.lit(1 << 31))


def mix_sources(
    docs: DataFrame,
    domain: Column,
    weight: Callable[[tuple], float],
    budget: Callable[[int], float],
    epochs: int = 1,
    seed: int = 17,
) -> DataFrame:
    """``doc_id, domain, lang, source, n_tokens, leaf_budget, copies, taken_tokens, text_hash`` for each row of ``docs``.

    Taken tokens of a leaf add up to its budget, rounded up. Of a document taken ``k``
    times with fewer than ``k`` times its tokens, the first tokens of the last copy are taken.

    ``weight(path)`` weighs the last step of a path of the tree, ``budget(total)``
    gives the tokens to take of ``total``, ``epochs`` bounds the passes over a leaf.
    """
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    rows = materialize(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_hash"), domain.cast("string").alias("domain"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), words.alias("n_tokens")
        ),
        "mix-rows",
    )
    # One row for each leaf of the tree; its size is that of the configuration.
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("n")).collect()
    have = {(r.domain, r.lang, r.source): r.n for r in leaves}
    total = sum(have.values())
    budgets = allocate(budget(total), {k: float(n * epochs) for k, n in have.items()}, weight)
    spark = docs.sparkSession
    plan = []
    for leaf, amount in budgets.items():
        n = have[leaf]
        full = min(epochs, int(amount // n)) if n else 0
        plan.append((*leaf, float(amount), full, float(amount - full * n) if n else 0.0))
    schema = "domain string, lang string, source string, leaf_budget double, full int, rest double"
    table = spark.createDataFrame(plan, schema)
    table = maybe_broadcast(table, len(plan), 120)

    def on_leaf(left: DataFrame, right: DataFrame) -> DataFrame:
        names = [c for c in right.columns if c not in LEVELS]
        right = right.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), *names)
        return left.join(right, [left[c].eqNullSafe(right[f"_{c}"]) for c in LEVELS]).drop(*(f"_{c}" for c in LEVELS))

    ranges = max(1, -(-total // RANGE_TOKENS))
    keyed = on_leaf(rows, table).withColumn("epoch", F.col("full")).withColumn("key", _key(seed)).withColumn("range", F.floor(F.col("key") * ranges / F.lit(1 << 31)))
    # Running tokens before each range of a leaf: one row for each leaf and range.
    sums = keyed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("in_range"))
    before = sums.select(*LEVELS, "range", (F.sum("in_range").over(Window.partitionBy(*LEVELS).orderBy("range")) - F.col("in_range")).alias("before"), "in_range")
    before = before.select(*(F.col(c).alias(f"_{c}") for c in LEVELS), F.col("range").alias("_range"), "before", "in_range")
    placed = keyed.join(before, [*(keyed[c].eqNullSafe(before[f"_{c}"]) for c in LEVELS), keyed["range"] == before["_range"]]).drop("_range", *(f"_{c}" for c in LEVELS))
    whole = placed.where((F.col("before") + F.col("in_range") <= F.col("rest")) | (F.col("before") >= F.col("rest")))
    whole = whole.withColumn("taken", (F.col("before") < F.col("rest")).cast("int")).withColumn("last", F.col("taken") * F.col("n_tokens"))
    cut = placed.where((F.col("before") + F.col("in_range") > F.col("rest")) & (F.col("before") < F.col("rest")))
    order = Window.partitionBy(*LEVELS).orderBy("key", "doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("rest") - F.col("before") - F.coalesce(F.sum("n_tokens").over(order), F.lit(0))
    cut = cut.withColumn("_left", left).withColumn("taken", (F.col("_left") > 0).cast("int"))
    cut = cut.withColumn("last", F.least(F.col("n_tokens"), F.greatest(F.ceil("_left"), F.lit(0).cast("long")))).drop("_left")
    out = whole.unionByName(cut)
    copies = F.when(F.col("n_tokens") > 0, F.col("full") + F.col("taken")).otherwise(0).cast("int")
    tokens = (F.col("full") * F.col("n_tokens") + F.col("last")).cast("long")
    return out.select("doc_id", *LEVELS, "n_tokens", "leaf_budget", copies.alias("copies"), tokens.alias("taken_tokens"), "text_hash")
