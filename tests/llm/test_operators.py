"""The training-data operators on small odd tables, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import chroma, context_model, exact_dedup, jaccard_join, langid, license_scan, mixing, pitman_yor, queries, seating, token_store, toxicity
from touchline.llm.components import connect

P = pytest.importorskip("public_tokenizers")

ODD = [
    (1, "The quick brown fox jumps over the lazy dog"), (2, "the  quick brown\nfox jumps over the lazy dog"), (3, None), (4, ""), (5, " \n\t "),
    (6, "One"), (7, "one"), (8, "a b c"), (9, "long " * 6000), (10, "é中文   ½ x\x0by"), (11, "The quick brown fox jumps over the lazy dog"), (12, "Thequick brown fox jumps over the lazy dog"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, and extra columns with clashing names."""
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    for name in ("kept", "h", "n", "cls", "score", "norm", "body", "key", "range", "_id", "copies", "word", "bucket"):
        df = df.withColumn(name, F.lit("x"))
    return df.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en")).withColumn("source", F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("src"), F.col("doc_id") % 4)))


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def deleted(text):
    return "".join(c for c in text or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("hasher", [exact_dedup.content_hash, lambda n: F.unhex(F.hex(F.crc32(n.cast("binary")) % 2))])
def test_exact_dedup(spark, odd, empty, hasher):
    got = by_id(exact_dedup.dedup_groups(odd, hasher))
    groups = {}
    for i, t in ODD:
        groups.setdefault(deleted(t), []).append((-len(t or ""), i))
    for i, t in ODD:
        g = groups[deleted(t)]
        keep = min(g)[1]
        assert got[i][:5] == (i, keep, len(g), i == keep, hashlib.sha256(deleted(t).encode()).hexdigest())
    assert exact_dedup.dedup_groups(empty, hasher).count() == 0


def components(texts, size=5, percent=80):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and jaccard_join.links(len(sets[a] & sets[b]), len(sets[a]), len(sets[b]), percent):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("seed", "group", "least", "summary"), [(1, 20_000, 64, None), (2, 9, 64, None), (3, 20_000, 4, 400), (4, 9, 4, 400)])
def test_jaccard_join(spark, monkeypatch, seed, group, least, summary):
    monkeypatch.setattr(jaccard_join, "GROUP_SETS", group)
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[rnd.choice(words) for _ in range(rnd.randrange(1, 70))] for _ in range(10)]
    texts = []
    for i in range(250):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 2, 5])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        texts.append((i, " ".join(t) if rnd.random() > 0.03 else rnd.choice([None, "", " "])))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    got = by_id(jaccard_join.join_components(df, least_frequent=least, summary=summary))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == components(texts)


def test_rows_with_one_id_are_rows_of_their_own(spark):
    """Repeated and null ids: one of each group of equal texts stays, and no other text goes."""
    rows = [(5, "ab"), (3, "a b"), (5, "unique text zzz"), (7, "same"), (7, "same"), (None, "same"), (None, "alone"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = exact_dedup.dedup_groups(df).collect()
    assert sorted((str(r.doc_id), r.keep_id, r.group_size) for r in got if r.kept) == [("3", 3, 2), ("5", 5, 1), ("7", 7, 3), ("None", None, 1), ("None", None, 1)]
    weak = exact_dedup.dedup_groups(df, lambda norm: F.lit(b"x")).collect()
    assert sorted(map(str, weak)) == sorted(map(str, got))
    near = [(4, "a b c d e f g h i j k l m"), (4, "a b c d e f g h i j k l m"), (4, "other words are here"), (2, "a b c d e f g h i j k l m n"), (None, "a b c d e f g h i j k l m"), (9, " "), (9, " ")]
    kept = jaccard_join.one_of_each(spark.createDataFrame(near, "doc_id long, text string"), ["doc_id", "text"]).collect()
    assert sorted(map(tuple, kept)) == [(2, near[3][1]), (4, "other words are here"), (9, " "), (9, " ")]


def test_jaccard_odd(odd, empty):
    got = by_id(jaccard_join.join_components(odd))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == components(ODD)
    assert jaccard_join.join_components(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 80)] + [(7, 7)]
    got = {r.v: r.root for r in connect(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[100 + i] for i in range(80)}) == 1 and len(set(got.values())) == 2


def test_toxicity_learns_and_spares(spark, odd, empty):
    rnd = random.Random(0)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(400):
        t = [rnd.choice(words) for _ in range(rnd.randrange(5, 60))]
        bad = i % 5 == 0
        if bad:
            t.insert(rnd.randrange(len(t)), rnd.choice(["vileone", "vileness", "rottenly"]))
        rows.append((i, " ".join(t), int(bad)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.where("doc_id < 300").drop("toxic"), df.select("doc_id", "toxic").where("doc_id < 300"))
    got = by_id(toxicity.tag(df, model))
    wrong = [i for i, _, bad in rows if i >= 300 and (got[i].score >= 0.3) != bool(bad)]
    assert not wrong
    i = next(i for i, _, bad in rows if i >= 300 and bad)
    text = rows[i][1].encode()
    assert any(text[s.start : s.end].startswith((b"vile", b"rotten")) for s in got[i].spans)
    scores = by_id(toxicity.tag(odd, model))
    assert len(scores) == len(ODD) and all(0 <= r.score <= 1 for r in scores.values()) and scores[3].score == 0
    assert toxicity.tag(empty, model).count() == 0
    none = toxicity.train(odd, odd.select("doc_id", F.lit(None).cast("int").alias("toxic")))
    assert {r.score for r in toxicity.tag(odd, none).collect()} == {0.0}


def test_lm_base_columns(spark, odd, empty):
    training = F.col("doc_id") % 2 == 1
    got = by_id(context_model.score(odd, training))
    tokens = {i: (t or "").encode().lower().split() + [b"\n"] for i, t in ODD}
    count = Counter(w for i, ws in tokens.items() if i % 2 for w in ws)
    n, v = sum(count.values()), len(count)
    for i, ws in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in count for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws))
        assert r.score < 0
    assert context_model.score(empty, training).count() == 0
    none = by_id(context_model.score(odd, F.lit(False)))
    assert all(r.score == pytest.approx(r.base_score) for r in none.values())


def test_lm_outcomes_add_up(spark):
    """After one context, the outcomes are the distinct training tokens and one for unseen words."""
    train = [(1, "b a b c"), (3, "a a d"), (5, "a")]
    single = [(2 * k + 100, w) for k, w in enumerate(["a", "b", "c", "d", "zz"])]
    pairs = [(2 * k + 200, f"{w} q") for k, w in enumerate(["a", "b", "c", "d", "zz"])]
    df = spark.createDataFrame([*train, *single, *pairs, (98, "")], "doc_id long, text string")
    got = {i: r.score for i, r in by_id(context_model.score(df, F.col("doc_id") % 2 == 1)).items()}
    # "w", end and "w q", end: what follows q after w is the same in both only for the first word, so take it by the unseen q.
    assert 10 ** got[98] < 1 and all(got[i + 100] < got[i] for i, _ in single)
    y, z, w = (np.array(x, np.uint64) for x in ([9, 9, 9, 1, 2], [9, 9, 9, 2, 2], [1, 2, 2, 2, 3]))
    model = context_model.Contexts(np.r_[y, [9] * 4].astype(np.uint64), np.r_[z, [9] * 4].astype(np.uint64), np.r_[w, [1, 2, 3, 4]].astype(np.uint64), np.r_[[1] * 5, [0] * 4])
    p = np.array([0.4, 0.3, 0.2, 0.1])[model.w.astype(int) - 1]
    for k in range(3):
        model.sweep(p, k)
        assert model.predictive(p)[0][model.at[0]][5:].sum() == pytest.approx(1.0)


def reference_scores(texts, training, p_word):
    """Contexts scored by plain dictionaries, with the table counts that fit one customer a dish."""
    n2, n1 = Counter(), Counter()
    rows = []
    for i, text in texts:
        ws = [*(text or "").lower().split(), None]
        before = ["^", "^", *ws]
        rows.append((i, [(before[k], before[k + 1], w) for k, w in enumerate(ws)]))
    for (i, _), (_, tokens) in zip(texts, rows, strict=True):
        if training(i):
            n2.update(tokens)
    n1.update((z, w) for y, z, w in n2)
    c2, t2, c1, t1 = Counter(), Counter(), Counter(), Counter()
    for (y, z, _), n in n2.items():
        c2[y, z] += n
        t2[y, z] += 1
    for (z, _), n in n1.items():
        c1[z] += n
        t1[z] += 1
    (d2, d1), s = context_model.DISCOUNTS, pitman_yor.STRENGTH
    out = {}
    for i, tokens in rows:
        total = 0.0
        for y, z, w in tokens:
            one = (n1[z, w] - d1 * (n1[z, w] > 0) + (s + d1 * t1[z]) * p_word(w)) / (s + c1[z])
            two = (n2[y, z, w] - d2 * (n2[y, z, w] > 0) + (s + d2 * t2[y, z]) * one) / (s + c2[y, z])
            total += math.log10(two)
        out[i] = total
    return out


def test_lm_follows_the_restaurants(spark, monkeypatch):
    """Where every dish has one table, the scores are those of plain dictionaries."""
    texts = [(1, "a b c"), (2, "a b c d"), (3, "c d e"), (4, "b a"), (5, None), (6, "e c d")]
    p = {"a": 0.1, "b": 0.2, "c": 0.1, "d": 0.2, "e": 0.1, None: 0.2}
    words = sorted(k for k in p if k)
    monkeypatch.setattr(context_model, "draw_tables", lambda n, *rest: np.ones(len(n), np.int64))
    ids = {w: k + 1 for k, w in enumerate(words)} | {"^": 50, None: 60}
    rows = [(i, [*(t or "").split(), None]) for i, t in texts]
    flat = [(i, y, z, w) for i, ws in rows for y, z, w in zip(["^", "^", *ws], ["^", *ws], ws, strict=False)]
    y, z, w = (np.array([ids[f[k]] for f in flat], np.uint64) for k in (1, 2, 3))
    model = context_model.Contexts(y, z, w, np.array([f[0] % 2 for f in flat]))
    back = {v: k for k, v in ids.items()}
    known = np.array([p[back[int(x)]] for x in model.w])
    model.sweep(known, 0)
    logs = np.log10(model.predictive(known)[0])[model.at[0]]
    got = Counter()
    for f, x in zip(flat, logs, strict=True):
        got[f[0]] += x
    want = reference_scores(texts, lambda i: i % 2, p.get)
    assert all(got[i] == pytest.approx(want[i]) for i in want)


def test_lm_scores_do_not_depend_on_the_layout(spark):
    rnd = random.Random(9)
    rows = [(i, " ".join(rnd.choice(["red", "fox", "runs", "home", "Old", "dog", "eats", "fish", "x" + str(rnd.randrange(40))]) for _ in range(rnd.randrange(60)))) for i in range(300)]
    df, training, before = spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") % 3 > 0, spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for layout, parts in ((2, 4), (7, 9)):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            found.append({i: r.score for i, r in by_id(context_model.score(df.repartition(layout), training)).items()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0].keys() == found[1].keys() and all(found[0][i] == pytest.approx(found[1][i], abs=1e-9) for i in found[0])


def test_lm_shares_of_frequent_words(spark, monkeypatch):
    """A word before very many others is dealt in shares; tokens keep their contexts."""
    shares = context_model.Shares(np.array([7], np.uint64), np.array([3 * context_model.SHARE_TOKENS]), 1)
    y = np.arange(1000, 2000, dtype=np.uint64)
    got = shares.split(y, np.full(1000, 7, np.uint64), y)
    assert len(set(got.tolist())) == 3 and (shares.split(y, y, y) == y).all()
    assert (got == shares.split(y, np.full(1000, 7, np.uint64), y[::-1].copy())).all()


def test_token_store(spark, odd, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    folder = token_store.new_folder(spark)
    manifest = token_store.write_store(odd, path, 0, folder)
    got = sorted(token_store.read_store(spark, folder, manifest).collect())
    start = 0
    for (doc, first, ids), (i, text) in zip(got, ODD, strict=True):
        want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        assert (doc, first) == (i, start) and np.frombuffer(ids, "<u4").tolist() == want
        start += len(want)
    assert token_store.read_document(folder, manifest, 10)[0].tolist() == [*t.encode(ODD[9][1], add_special_tokens=False).ids, 0]
    assert token_store.read_document(folder, manifest, 99) == []
    other = token_store.new_folder(spark)
    assert token_store.read_store(spark, other, token_store.write_store(empty, path, 0, other)).count() == 0


def test_token_store_begins_new_files(spark):
    rows = [(i, f"text {i} <|endoftext|> " * (i % 7)) for i in range(60)]
    path, folder = P.path("byte_bpe_50k.json"), token_store.new_folder(spark)
    manifest = token_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), path, 0, folder, file_bytes=100)
    assert manifest.count() > 6
    from tokenizers import Tokenizer

    t, got = Tokenizer.from_file(path), sorted(token_store.read_store(spark, folder, manifest).collect())
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [[*t.encode(x, add_special_tokens=False).ids, 0] for _, x in rows]
    assert [r.start for r in got] == [sum(len(g.ids) // 4 for g in got[:i]) for i in range(60)]
    assert token_store.read_document(folder, manifest, 33)[0].tolist() == [*t.encode(rows[33][1], add_special_tokens=False).ids, 0]


def test_encoder_follows_the_library():
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rnd = random.Random(1)
    parts = ["a", "the", " ", "\n", "\t", " x", "  ", "é", "\x1c", "'s", "9", "<|endoftext|>", "!", "　", "中", "\r\n", "ª", "ǅ", "...", "word,", " ", "\x85"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(1500)]
    got = token_store.Encoder(path).encode([x.encode() for x in texts])
    want = [np.array(e.ids, "<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]
    assert got == want


def test_byte_bpe(spark, odd, empty):
    import tiktoken

    from touchline.llm import byte_bpe

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = byte_bpe.read_ranks(path)
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    rows = ODD + [(100 + i, "".join(rnd.choice("abetho e中\n1") for _ in range(rnd.randrange(900)))) for i in range(40)] + [(200, "ab" * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(byte_bpe.roundtrip(df, path, P.PATTERN))
    for i, text in rows:
        assert np.frombuffer(got[i].ids, "<u4").tolist() == reference.encode_ordinary(text or "")
        assert got[i].decoded == (text or "").encode()
    again = by_id(byte_bpe.decode(byte_bpe.encode(odd, path, P.PATTERN), path))
    assert all(bytes(again[i].decoded) == (t or "").encode() for i, t in ODD)
    assert byte_bpe.roundtrip(empty, path, P.PATTERN).count() == 0


def test_language(spark, odd, empty):
    f = langid.train(odd)
    got = by_id(langid.predict(odd, f))
    assert got[3].lang_pred == "und" and got[4].lang_pred == "und" and got[5].lang_pred == "und" and got[1].lang_pred == "en"
    kept = langid.keep_known(odd, f, 0.2, ["doc_id", "text", "lang"])
    assert {1, 2, 11} <= {r.doc_id for r in kept.collect()} and kept.columns == ["doc_id", "text", "lang"]
    nothing = langid.train(empty)
    assert {r.lang_pred for r in langid.predict(odd, nothing).collect()} == {"und"}
    assert langid.predict(empty, f).count() == 0


def test_licenses(spark, empty):
    rows = [(1, "x CC BY y. Licensed under the Apache Licence, Version 2.0"), (2, None), (3, "This work is licensed under the GNU General Public License."), (4, "word " * 9000 + "All rights reserved")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(license_scan.scan(df))
    assert [b.asDict() for b in got[1].base] == [{"word": 1, "label": "cc-by"}]
    assert {n.label for n in got[1].notices} >= {"apache-2.0"} and got[2].n_words == 0 and got[2].base == []
    assert {n.label for n in got[3].notices} == {"gpl"}
    assert got[4].base[0].word == 9000 and got[4].n_words == 9003
    assert license_scan.scan(empty).count() == 0


def test_mixing_takes_prefixes(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_TOKENS", 40)
    rnd = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rnd.randrange(9))), rnd.choice(["en", "de"]), rnd.choice(["src0", "src1", "src5", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    for epochs, share in ((1, 0.5), (3, 1.7), (2, 0.0), (2, 9.0)):
        out = mixing.mix_sources(df, queries.mix_domain(), queries.mix_weight, lambda total, s=share: total * s, epochs=epochs)
        keyed = out.withColumn("full", F.floor(F.col("leaf_budget") / F.nullif(F.sum("n_tokens").over(__import__("pyspark").sql.Window.partitionBy("domain", "lang", "source")), F.lit(0)))).collect()
        assert len(keyed) == 400
        leaves = {}
        for r in keyed:
            leaves.setdefault((r.domain, r.lang, r.source), []).append(r)
        for leaf in leaves.values():
            budget, taken = leaf[0].leaf_budget, sum(r.n_tokens * r.copies for r in leaf)
            longest = max(r.n_tokens for r in leaf)
            assert budget - 1e-6 <= taken < budget + longest or taken == budget
            assert sum(r.taken_tokens for r in leaf) == math.ceil(round(budget, 6))
            cut = [r for r in leaf if r.taken_tokens != r.n_tokens * r.copies]
            assert len(cut) <= 1 and all((r.copies - 1) * r.n_tokens < r.taken_tokens < r.copies * r.n_tokens for r in cut)
            counts = {r.copies for r in leaf if r.n_tokens}
            assert max(counts, default=0) <= epochs and (not counts or max(counts) - min(counts) <= 1)
    assert len(mixing.mix_sources(odd, queries.mix_domain(), queries.mix_weight, lambda t: t / 2).collect()) == len(ODD)
    assert mixing.mix_sources(empty, queries.mix_domain(), queries.mix_weight, lambda t: t / 2).count() == 0


def test_recordings(spark):
    rng = np.random.default_rng(0)
    vectors = [[float(x) for x in rng.normal(0, 0.13, 64)] for _ in range(6)]
    media = [chroma.render(v) for v in vectors]
    shifted = chroma.write_wav(chroma.RATE, np.concatenate([np.zeros(chroma.HOP * 5), chroma.read_wav(media[1])[1]]))
    rows = [(20, media[0]), (21, media[0]), (22, media[0]), (40, media[1]), (41, shifted), (60, None), (61, b""), (62, b"RIFFbroken"), (80, media[5])]
    got = by_id(chroma.match(spark.createDataFrame(rows, "rec_id long, media binary")), "rec_id")
    assert [got[i].class_id for i in (20, 21, 22)] == [20, 20, 20] and got[20].class_size == 3 and got[20].n_matches == 0
    assert (got[40].n_matches, got[40].best_id, got[40].best_offset) == (1, 41, 5) and got[41].n_matches is None
    assert got[60].n_matches == 0 and got[61].class_id == 61 and got[62].n_frames == 0
    assert chroma.match(chroma.recordings(spark.createDataFrame([], "vec_id long, embedding array<float>"))).count() == 0


def test_index_recall_of_noisy_copies(spark):
    """Matches that comparing all pairs finds, and the share of them that the index gives."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(24):
        rate, samples = chroma.read_wav(chroma.render([float(x) for x in rng.normal(0, 0.13, 64)]))
        rows.append((20 * i, chroma.write_wav(rate, samples)))
        for k in (1, 2):
            shift = np.zeros(chroma.HOP * int(rng.integers(0, 9)) + int(rng.integers(0, 60)))
            noisy = np.concatenate([shift, samples])
            rows.append((20 * i + k, chroma.write_wav(rate, noisy + rng.normal(0, 0.03, len(noisy)))))
    codes = {i: chroma.integers(chroma.chroma_frames(*chroma.read_wav(m))) for i, m in rows}
    want = 0
    for q in range(0, 480, 20):
        for y in codes:
            at = chroma.align(codes[q], codes[y]) if y != q else None
            want += bool(at and at[1] <= chroma.MAX_ERROR and at[2] >= chroma.MIN_OVERLAP)
    got = sum(r.n_matches or 0 for r in chroma.match(spark.createDataFrame(rows, "rec_id long, media binary")).collect())
    assert want >= 24 and want >= got >= 0.9 * want


def _every_offset(a, b):
    """Whether some offset of all matches, votes or none, without frames that are silent in both."""
    a, b = a.tolist(), b.tolist()
    for offset in range(-len(a), len(b) + 1):
        s, e = max(0, -offset), min(len(a), len(b) - offset)
        x, y = a[s:e], b[s + offset : e + offset]
        bits = [32 if (p == chroma.SILENT) != (q == chroma.SILENT) else (int(p) ^ int(q)).bit_count() for p, q in zip(x, y, strict=True) if not p == q == chroma.SILENT]
        if len(bits) >= chroma.MIN_OVERLAP and sum(bits) <= chroma.MAX_ERROR * 32 * len(bits):
            return True
    return False


@pytest.mark.parametrize("common", [1000, 2])
def test_excerpts_and_silence(spark, monkeypatch, common):
    """Excerpts of a long recording, recordings that share silence or a held note, and others, against all offsets of all pairs."""
    monkeypatch.setattr(chroma, "COMMON", common)
    rng = np.random.default_rng(11)
    tune = lambda n: chroma.read_wav(chroma.render([float(x) for x in rng.normal(0, 0.13, n)]))[1]
    still = np.zeros(400 * chroma.HOP)
    held = 0.4 * np.sin(2 * np.pi * 440 * np.arange(200 * chroma.HOP) / chroma.RATE)
    long = tune(1200)
    sounds = {0: long, 20: np.concatenate([tune(64), still]), 21: np.concatenate([still, tune(64)]), 40: np.concatenate([tune(20), held]), 41: np.concatenate([held, tune(20)]), 60: still, 61: still[: len(still) // 2]}
    for k in range(1, 8):
        at = int(rng.integers(0, len(long) - 110 * chroma.HOP))
        part = long[at : at + 110 * chroma.HOP]
        sounds[k] = part + rng.normal(0, 0.02, len(part))
    for k in range(100, 125):
        sounds[k] = tune(64)
    rows = [(k, chroma.write_wav(chroma.RATE, v)) for k, v in sounds.items()]
    codes = {k: chroma.integers(chroma.chroma_frames(*chroma.read_wav(m))) for k, m in rows}
    got = by_id(chroma.match(spark.createDataFrame(rows, "rec_id long, media binary").repartition(3)), "rec_id")
    want = {q: sum(_every_offset(codes[q], codes[y]) for y in codes if y != q) for q in codes if q % 20 == 0}
    assert want[0] >= 7 and want[40] == 1 and want[20] == want[60] == 0
    assert all((got[q].n_matches or 0) <= n for q, n in want.items())
    assert sum(got[q].n_matches for q in want) >= 0.9 * sum(want.values())
    assert got[20].n_matches == got[60].n_matches == 0


def test_lm_word_order_counts(spark):
    rnd = random.Random(4)
    rows = [(2 * i + 1, " ".join(rnd.choice(["red fox runs home", "old dog eats fish", "a cat"]) for _ in range(6))) for i in range(60)] + [(2, "red fox runs home"), (4, "home fox red runs"), (6, "zz")]
    got = by_id(context_model.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), F.col("doc_id") % 2 == 1))
    assert got[2].score > got[4].score + 2 and got[2].base_score == pytest.approx(got[4].base_score)


def test_tables_are_drawn_from_their_conditional():
    """Against the weights of all table counts, below and above ``EXACT``."""
    for n, rest, p, d in ((5, 3.0, 0.2, 0.5), (60, 40.0, 0.1, 0.3), (300, 9.0, 0.3, 0.7), (600, 40.0, 0.1, 0.3), (700, 2000.0, 0.01, 0.8)):
        weight = seating.log_ways(n, d)[n, 1:] + np.cumsum(np.log((rest + d * np.arange(n)) * p))
        want = np.exp(weight - weight.max())
        want /= want.sum()
        got = seating.draw_tables(np.full(3000, n), np.full(3000, rest), np.full(3000, p), d, np.arange(3000), 4)
        mean = (want * np.arange(1, n + 1)).sum()
        assert got.mean() == pytest.approx(mean, rel=0.03)


def test_lm_sweeps_resample_every_customer(spark):
    """Tables follow their conditional however many customers a word has, and are the customers of the spelling."""
    words = spark.createDataFrame([(b"ab", 30_000, 1), (b"cd", 400, 1)], "word binary, c long, tables long")
    spelling = np.full((pitman_yor.CONTEXTS, pitman_yor.SYMBOLS), 0.3)
    got = {bytes(r.word): r for r in pitman_yor._word_seats(words, spelling, 0.5, 2000, 1, 4).collect()}
    p0 = 0.99 * 0.3**3
    for word, n in ((b"ab", 30_000), (b"cd", 400)):
        ways = seating.log_ways(400, 0.5)[400, 1:] + np.cumsum(np.log((1 + 0.5 * 1999 + 0.5 * np.arange(400)) * p0))
        want = (np.exp(ways - ways.max()) * np.arange(1, 401)).sum() / np.exp(ways - ways.max()).sum()
        seats = got[word].seats
        assert len(set(seats)) > 1
        if n == 400:
            assert abs(np.mean(seats) - want) < 0.25 * want
    cells = pitman_yor._spelling_cells(words.withColumn("tables", F.lit(7).cast("long")))
    assert cells.sum() == 2 * 3 * 7
