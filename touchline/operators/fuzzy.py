"""Similarity joins of names that lose no pair: pieces, shared tokens, falling bounds.

Candidates meet on keys that every pair above the bound must share; bounds in
built-in functions cut them down before an Arrow UDF scores what is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity
from .lineage import cut

#: Pairs that one token may bring together by itself; beyond, its names meet on more (``_by_hot_tokens``).
HOT_PAIRS = 1 << 20


def piece_index(df: DataFrame, key: str, text: str, least: float, block: str | None = None) -> DataFrame:
    """Pieces of the texts (``_k, _in, _n, _at, _len, _piece``), to be stored and probed by ``probe_pieces``.

    Two texts with an indel ratio of ``least`` are at most ``d`` insertions and deletions
    apart. One text in ``d + 1`` pieces keeps at least one of them whole in the other.
    """
    share, r = 1 - least / 100, least / 100
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), (F.col(block) if block else F.lit("")).alias("_in")).where(F.length("_t") > 0)
    n = F.length("_t")
    # d is at most share * (own + longest partner), the partner being at most own * (2 - r) / r.
    most = F.floor(F.lit(share * (1 + (2 - r) / r)) * n + 1e-9)
    count = F.least(most + 1, n)
    pieces = F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: F.struct(F.floor(i * n / count).cast("int").alias("at"), (F.floor((i + 1) * n / count) - F.floor(i * n / count)).cast("int").alias("len")))
    return rows.withColumn("_p", F.explode(pieces)).select("_k", "_in", n.alias("_n"), F.col("_p.at").alias("_at"), F.col("_p.len").alias("_len"), F.expr("substring(_t, _p.at + 1, _p.len)").alias("_piece"))


def probe_pieces(index: DataFrame, df: DataFrame, key: str, text: str, least: float, block: str | None = None) -> DataFrame:
    """``_k, _k2``: indexed keys and keys of ``df`` that share a piece moved by at most ``d``; no pair of the ratio is lost."""
    share = 1 - least / 100
    rows = df.select(F.col(key).alias("_k2"), F.col(text).alias("_t"), (F.col(block) if block else F.lit("")).alias("_in")).where(F.length("_t") > 0)
    n = F.length("_t")
    lengths = sorted(index.agg(F.collect_set("_len").alias("v")).first().v or [])  # lengths of pieces: a handful
    kind = "array<struct<at:int,piece:string>>"

    def windows_of(size: int) -> Column:
        cut = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.struct(i.alias("at"), F.substring(F.col("_t"), i + 1, F.lit(size)).alias("piece")))
        return F.when(n >= size, cut).otherwise(F.array().cast(kind))

    windows = F.flatten(F.array(*map(windows_of, lengths))) if lengths else F.array().cast(kind)
    probes = rows.withColumn("_w", F.explode(windows)).select("_k2", "_in", n.alias("_n2"), F.col("_w.at").alias("_at2"), F.col("_w.piece").alias("_piece"))
    met = index.join(probes, ["_in", "_piece"]).where(F.abs(F.col("_at") - F.col("_at2")) <= F.lit(share) * (F.col("_n") + F.col("_n2")) + 1e-9)
    return met.where(F.least("_n", "_n2") * 200 >= F.lit(float(least)) * (F.col("_n") + F.col("_n2"))).select("_k", "_k2").distinct()


def indel_candidates(df: DataFrame, key: str, text: str, least: float, block: str | None = None) -> DataFrame:
    """Pairs of keys (of a ``block``) that may have an indel ratio of ``least`` or more; none is lost."""
    met = probe_pieces(piece_index(df, key, text, least, block), df, key, text, least, block).where(F.col("_k") != F.col("_k2"))
    return met.select(F.least("_k", "_k2").alias("a"), F.greatest("_k", "_k2").alias("b")).distinct()


def _words(c: Column) -> Column:
    """Sorted distinct tokens."""
    return F.array_sort(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != "")))


def _text(words: Column) -> Column:
    return F.array_join(words, " ")


def _by_rare_tokens(q: DataFrame, c: DataFrame) -> DataFrame:
    """Pairs that share a token that is not hot; each comes out once, at the first such token."""
    one = lambda df, s: df.select("_scope", F.col("_text").alias(f"_{s}"), F.col("_rare").alias(f"_rare_{s}"), F.explode("_rare").alias("_word"))
    met = one(q, "q").join(one(c, "c"), ["_scope", "_word"])
    return met.where(F.col("_word") == F.element_at(F.array_intersect("_rare_q", "_rare_c"), 1)).select("_scope", "_q", "_c")


#: Lengths of pieces, longest first.
PIECES = (6, 5, 4, 3, 2, 1)


def _pieces(tokens: Column, of: Column, size: int) -> Column:
    """Pieces of one length within those tokens that are in ``of``, with their place in the tokens' text."""
    start = lambda i: F.aggregate(F.slice(tokens, F.lit(1), i), F.lit(0), lambda n, w: n + F.length(w) + 1)

    def cut_token(w: Column, i: Column) -> Column:
        count = F.floor(F.length(w) / size).cast("int")
        cut = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct((start(i) + k * size).alias("at"), F.substring(w, k * size + 1, F.lit(size)).alias("piece")))
        return F.when((count > 0) & F.array_contains(of, w), cut).otherwise(F.array().cast("array<struct<at:int,piece:string>>"))

    return F.flatten(F.transform(tokens, cut_token))


def _by_hot_tokens(q: DataFrame, c: DataFrame, least: float) -> DataFrame:
    """Pairs that share hot tokens only, or none: they meet on exactly the set ``S`` that they share.

    With ``S`` before the rest, a ratio of ``least`` needs rests that differ by at most
    ``d`` letters, so one of ``d + 1`` pieces of the choice's is whole in the query's; or one
    rest that is short against ``S``. Pieces are taken from rare tokens, and from hot ones
    only for names that have little else.
    """
    share, r = 1 - least / 100, least / 100

    def by_set(df: DataFrame) -> DataFrame:
        masks = F.sequence(F.lit(0), F.call_function("shiftleft", F.lit(1), F.size("_hot")) - 1)
        rows = df.withColumn("_mask", F.explode(masks))
        chosen = F.filter("_hot", lambda w, i: F.call_function("shiftright", F.col("_mask"), i).bitwiseAND(1) == 1)
        rows = rows.withColumn("_S", _text(chosen)).withColumn("_left", F.array_except("_hot", chosen)).withColumn("_tokens", F.array_sort(F.concat("_rare", "_left"))).withColumn("_rest", _text(F.col("_tokens")))
        return rows.withColumn("_n", F.length("_rest") + F.length("_S") + F.when((F.col("_S") != "") & (F.col("_rest") != ""), 1).otherwise(0)).select("_scope", "_text", "_S", "_rest", "_n", "_rare", "_left", "_tokens")

    q, c = by_set(q), by_set(c)
    size, total = F.length("_rest"), F.col("_n")
    need = F.floor(F.lit(share * (1 + (2 - r) / r)) * total + 1e-9).cast("int") + 1  # one more than the most letters that differ
    chosen = None
    for of, k in [*((F.col("_rare"), k) for k in PIECES[:-1]), *((F.col("_tokens"), k) for k in PIECES)]:
        enough = F.aggregate(of, F.lit(0), lambda n, w: n + F.floor(F.length(w) / k).cast("int")) >= need  # noqa: B023
        here = F.slice(_pieces(F.col("_tokens"), of, k), F.lit(1), need)
        chosen = F.when(enough, here) if chosen is None else chosen.when(enough, here)
    c = c.withColumn("_pieces", chosen)
    indexed = c.where("_pieces IS NOT NULL").withColumn("_p", F.explode("_pieces"))
    indexed = indexed.select("_scope", "_S", F.col("_text").alias("_c"), F.col("_left").alias("_left_c"), size.alias("_size_c"), total.alias("_n_c"), F.col("_p.at").alias("_at_c"), F.col("_p.piece").alias("_piece"))
    windows = F.flatten(F.array(*(F.when(size >= k, F.transform(F.sequence(F.lit(0), size - k), lambda i: F.struct(i.alias("at"), F.substring(F.col("_rest"), i + 1, F.lit(k)).alias("piece")))).otherwise(F.array().cast("array<struct<at:int,piece:string>>")) for k in PIECES)))  # noqa: B023
    own = lambda df, s: df.select("_scope", "_S", F.col("_text").alias(f"_{s}"), F.col("_left").alias(f"_left_{s}"), size.alias(f"_size_{s}"), total.alias(f"_n_{s}"))
    apart = ~F.arrays_overlap("_left_q", "_left_c")  # else they meet on a larger set
    may = apart & (F.abs(F.col("_size_q") - F.col("_size_c")) <= F.lit(share) * (F.col("_n_q") + F.col("_n_c")) + 1e-9)
    probes = q.withColumn("_w", F.explode(windows)).select("_scope", "_S", F.col("_text").alias("_q"), F.col("_left").alias("_left_q"), size.alias("_size_q"), total.alias("_n_q"), F.col("_w.at").alias("_at_q"), F.col("_w.piece").alias("_piece"))
    near = F.abs(F.col("_at_q") - F.col("_at_c")) <= F.lit(share) * (F.col("_n_q") + F.col("_n_c")) + 1e-9
    found = indexed.join(probes, ["_scope", "_S", "_piece"]).where(may & near).select("_scope", "_q", "_c")
    short = (F.col("_S") != "") & ((size == 0) | (size + 1 <= 2 * F.length("_S") * (1 - r) / r + 1e-9))
    for left, right, when in ((own(c.where("_pieces IS NULL"), "c"), own(q, "q"), may), (own(c.where(short), "c"), own(q, "q"), apart), (own(c, "c"), own(q.where(short), "q"), apart)):
        found = found.unionByName(left.join(right, ["_scope", "_S"]).where(when).select("_scope", "_q", "_c"))
    return found


def set_ratio_pairs(queries: DataFrame, choices: DataFrame, least: float, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``_scope, _q, _c, score``: texts ``_scope, _text`` of both sides with a token set ratio of ``least`` or more.

    Nothing is lost and nothing tried that shares neither a rare token, nor a set of
    hot ones and a piece of the rest. Blank texts match nothing.
    """
    sides = [df.select("_scope", "_text").distinct().withColumn("_w", _words(F.col("_text"))).where(F.size("_w") > 0) for df in (queries, choices)]
    counts = [df.select("_scope", F.explode("_w").alias("_word")).groupBy("_scope", "_word").agg(F.count("*").alias(n)) for df, n in zip(sides, ("_nq", "_nc"), strict=True)]
    hot = cut(counts[0].join(counts[1], ["_scope", "_word"]).where(F.col("_nq") * F.col("_nc") > hot_pairs).select("_scope", "_word", F.lit(True).alias("_is_hot")))
    if hot.isEmpty():
        q, c = (df.withColumn("_rare", F.col("_w")).withColumn("_hot", F.array().cast("array<string>")) for df in sides)
    else:
        def dealt(df):
            of = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("_word"))))
            marked = df.select("_scope", "_text", F.explode("_w").alias("_word")).join(hot, ["_scope", "_word"], "left")
            return marked.groupBy("_scope", "_text").agg(of(F.col("_is_hot").isNull()).alias("_rare"), of(F.col("_is_hot").isNotNull()).alias("_hot")).withColumn("_w", F.array_sort(F.concat("_rare", "_hot")))

        q, c = (cut(dealt(df)) for df in sides)
    met = _by_rare_tokens(q, c).unionByName(_by_hot_tokens(q, c, least)).distinct()
    both = met.withColumns({"_wq": _words(F.col("_q")), "_wc": _words(F.col("_c"))})
    both = both.withColumns({"_both": _text(F.array_intersect("_wq", "_wc")), "_a": _text(F.array_except("_wq", "_wc")), "_b": _text(F.array_except("_wc", "_wq"))})
    s, a, b = F.length("_both"), F.length("_a"), F.length("_b")
    gap = F.when(s > 0, 1).otherwise(0)
    total = 2 * (s + gap) + a + b
    inside = (s > 0) & ((a == 0) | (b == 0))
    by_shared = F.when(s > 0, 200 * s / (2 * s + 1 + F.least(a, b))).otherwise(0.0)
    by_rest = 100 * (1 - F.greatest(F.abs(a - b), F.levenshtein("_a", "_b")) / total)  # indels are no fewer than edits
    scored = both.where(inside | (F.greatest(by_shared, by_rest) >= least - 1e-9))
    return scored.withColumn("score", similarity.token_set_ratio(F.col("_q"), F.col("_c"))).where(F.col("score") >= least).select("_scope", "_q", "_c", "score")


def set_ratio_hits(queries: DataFrame, choices: DataFrame, least: float, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Queries (``_scope, raw, _query``) with ``choice, choice_id`` of their scope whose token set ratio is at least ``least``, as ``score``."""
    pairs = set_ratio_pairs(queries.select("_scope", F.col("_query").alias("_text")), choices.select("_scope", F.col("choice").alias("_text")), least, hot_pairs)
    named = pairs.withColumnsRenamed({"_q": "_query", "_c": "choice"})
    return queries.join(named, ["_scope", "_query"]).join(choices, ["_scope", "choice"]).select("_scope", "raw", "_query", "choice", "choice_id", "score")


def _letters(c: Column) -> Column:
    """Each letter with its number among its like, so that common elements count common letters."""
    chars = F.split(c, "")
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(F.transform(chars, lambda x, i: F.concat(x, F.size(F.filter(F.slice(chars, 1, i + 1), lambda y: y == x)).cast("string"))))


def best_matches(queries: DataFrame, choices: DataFrame, steps: tuple[int, ...] = (88,), bands: tuple[float, ...] = (0.9, 0.75, 0.6, 0.4, 0.0)) -> DataFrame:
    """ER-17: ``scope, query, choice, rank, score`` of the best token sort ratio above 0, by falling bounds.

    ``queries (_scope, query)``, ``choices (_scope, choice, rank)``; of equal scores the
    least rank. First come candidates that must be there for a ratio of each step; a
    query whose best reaches the step is done. The others meet choices by length, near
    ones first: a band ends where the length alone bounds the ratio, and a query whose
    best is above that bound is done. Within a band, common letters bound the ratio
    before it is computed. What meets is keyed by scope and length, so that a large
    scope is spread.
    """
    in_order = lambda c: _text(F.array_sort(F.filter(F.split(c, r"\s+"), lambda w: w != "")))
    q = queries.select("_scope", "query").distinct().withColumn("_q", in_order(F.col("query"))).where("_q <> ''")
    c = choices.withColumn("_c", in_order(F.col("choice"))).where("_c <> ''").groupBy("_scope", "_c").agg(F.min("rank").alias("rank"), F.min_by("choice", "rank").alias("choice"))
    c = cut(c)
    better = F.max(F.struct("score", (-F.col("rank")).alias("_r"), "choice", "rank")).alias("best")
    open_ = cut(q.select("_scope", "_q").distinct().withColumn("best", F.lit(None).cast("struct<score:double,_r:bigint,choice:string,rank:bigint>")))
    c = c.withColumn("rank", F.col("rank").cast("long"))
    done = []

    def settle(found: DataFrame, bound: float) -> None:
        nonlocal open_
        scored = found.withColumn("score", similarity.token_sort_ratio(F.col("_q"), F.col("_c"))).where("score > 0")
        merged = scored.groupBy("_scope", "_q").agg(better)
        joined = open_.select("_scope", "_q", F.col("best").alias("_was")).join(merged, ["_scope", "_q"], "left").select("_scope", "_q", F.greatest("_was", "best").alias("best"))
        joined = cut(joined)
        is_done = F.coalesce(F.col("best.score") >= bound, F.lit(False))
        done.append(joined.where(is_done))
        open_ = joined.where(~is_done)

    for step in steps:
        texts = open_.select("_scope", F.col("_q").alias("_text"), F.lit(True).alias("_own")).unionByName(c.select("_scope", F.col("_c").alias("_text"), F.lit(False).alias("_own")))
        keyed = texts.select(F.to_json(F.struct("_scope", "_text", "_own")).alias("_k"), "_text", "_scope", "_own")
        near = indel_candidates(keyed, "_k", "_text", step, block="_scope")
        side = lambda k: F.from_json(k, "_scope string, _text string, _own boolean")
        pairs = near.select(side("a").alias("a"), side("b").alias("b")).where("a._own <> b._own")
        pairs = pairs.select(F.col("a._scope").alias("_scope"), F.when(F.col("a._own"), F.col("a._text")).otherwise(F.col("b._text")).alias("_q"), F.when(F.col("a._own"), F.col("b._text")).otherwise(F.col("a._text")).alias("_c"))
        settle(pairs.join(c, ["_scope", "_c"]), step)
    before = 1.01
    for band in bands:
        if open_.isEmpty():
            break
        n, m = F.length("_q"), F.length("_c")
        sized = c.select("_scope", m.alias("_m")).distinct()
        # 2 * min / (n + m) bounds the ratio; each query asks for the lengths of this band.
        bound = 2 * F.least(n, F.col("_m")) / (n + F.col("_m"))
        asked = open_.join(sized, "_scope").where((bound < before) & (bound >= band) & (100 * bound >= F.coalesce("best.score", F.lit(0.0)) - 1e-9))
        met = asked.select("_scope", "_q", "_m", F.col("best.score").alias("_so_far")).join(c.withColumn("_m", m), ["_scope", "_m"])
        common = F.size(F.array_intersect(_letters(F.col("_q")), _letters(F.col("_c"))))
        met = met.where((common > 0) & (200 * common / (n + m) >= F.coalesce("_so_far", F.lit(0.0)) - 1e-9))
        settle(met.select("_scope", "_q", "_c", "choice", "rank"), 100 * band + (1e-9 if band else 0))
        before = band
    out = open_
    for more in done:
        out = out.unionByName(more)
    out = out.where("best IS NOT NULL")
    return q.join(out, ["_scope", "_q"]).select(F.col("_scope").alias("scope"), "query", "best.choice", "best.rank", "best.score")


def winkler_pairs(texts: DataFrame, least: float = 0.9) -> DataFrame:
    """SIM-08: ``_scope, a, b, jw`` of different texts (``_scope, _text``) of a scope with a Jaro-Winkler similarity of ``least`` or more.

    With a shared start of ``k`` letters (4 at most) a Jaro similarity of ``t(k)`` is
    needed, which needs common letters: at least ``(3t - 1) * n * m / (n + m)``, so of a
    text of ``n`` letters all but ``n - ceil((3t - 2) * n)`` are common. Pairs meet on their
    start and one of the first letters, rarest first, that cannot all be missing.
    """
    rows = texts.select("_scope", "_text").distinct().where("_text <> ''").withColumn("_l", _letters(F.col("_text")))
    often = rows.select(F.explode("_l").alias("_x")).groupBy("_x").agg(F.count("*").alias("_df"))
    letters = rows.select("_scope", "_text", F.explode("_l").alias("_x")).join(often, "_x")
    ranked = cut(letters.groupBy("_scope", "_text").agg(F.array_sort(F.collect_list(F.struct("_df", "_x"))).alias("_all")).join(rows, ["_scope", "_text"]))
    n = F.length("_text")
    need = lambda k: (least - 0.1 * k) / (1 - 0.1 * k)
    found = None
    for k in range(5):
        t = need(k)
        first = n - F.ceil((3 * t - 2) * n - 1e-9).cast("int") + 1
        heads = ranked.where(n >= k).select("_scope", "_text", "_l", F.substring("_text", 1, k).alias("_start"), F.explode(F.transform(F.slice("_all", F.lit(1), F.least(first, n)), lambda x: x["_x"])).alias("_x"))
        side = lambda s: heads.select("_scope", "_start", "_x", F.col("_text").alias(s), F.col("_l").alias(f"_l{s}"))  # noqa: B023, E731
        na, nb = F.length("a"), F.length("b")
        met = side("a").join(side("b"), ["_scope", "_start", "_x"]).where(F.col("a") < F.col("b"))
        met = met.where(F.size(F.array_intersect("_la", "_lb")) * (na + nb) >= (3 * t - 1) * na * nb - 1e-9).select("_scope", "a", "b")
        found = met if found is None else found.unionByName(met)
    return found.distinct().withColumn("jw", similarity.jaro_winkler(F.col("a"), F.col("b"))).where(F.col("jw") >= least)
