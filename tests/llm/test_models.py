"""The cores of the training-data operators, without Spark."""

import itertools
import random
import zlib

import numpy as np
import pytest

from touchline.llm import chroma, langid, license_scan, mixing, pitman_yor, textvec, toxicity
from touchline.llm.jaccard_join import Frequent, Trie, links


def test_words_and_shingles_follow_bytes():
    texts = [b"", b"  \n", b"One", "É\x0bb C d  e f g".encode(), b"a b c d e f", b"one"]
    w = textvec.Words(texts)
    assert w.count.tolist() == [len(t.lower().split()) for t in texts]
    h, d = textvec.shingle_hashes(w, 5)
    assert np.bincount(d, minlength=6).tolist() == [0, 0, 1, 2, 2, 1]
    assert h[d == 2] == h[d == 5]
    again, _ = textvec.shingle_hashes(textvec.Words([b"x y z"] * 3 + [texts[4]]), 5)
    assert set(h[d == 4].tolist()) <= set(again.tolist())


def test_trie_keeps_every_link():
    rnd = random.Random(1)
    for _ in range(40):
        base = [rnd.sample(range(60), rnd.randrange(1, 30)) for _ in range(4)]
        sets, sizes = [], []
        for _ in range(25):
            s = {x if rnd.random() > 0.07 else rnd.randrange(60) for x in rnd.choice(base)}
            sets.append(np.array(sorted(s), np.uint64))
            sizes.append(len(s) + rnd.choice([0, 0, 1]))  # items nobody shares
        got = Trie(sets, sizes, 80).join()
        parent = list(range(25))

        def find(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, j in itertools.combinations(range(25), 2):
            if links(len(set(sets[i].tolist()) & set(sets[j].tolist())), sizes[i], sizes[j], 80):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        assert got == [find(x) for x in range(25)]


def test_trie_walks_long_paths():
    sets = [np.arange(n, dtype=np.uint64) for n in range(1, 1300)]
    got = Trie(sets, list(range(1, 1300)), 80).join()
    assert got[:4] == [0, 1, 2, 3] and set(got[4:]) == {3}


def test_frequent_items_are_never_lost():
    rng = np.random.default_rng(0)
    items = np.concatenate([np.repeat(np.arange(5, dtype=np.uint64), 300), rng.integers(100, 1 << 40, 4000).astype(np.uint64)])
    rng.shuffle(items)
    f = Frequent(40)
    for part in np.array_split(items, 13):
        f.add(part)
    assert set(range(5)) <= set(f.items.tolist()) and len(f.items) <= 40


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    gaps, tail = [[0, 2], [1], [], [3, 0, 1]], np.array([1, 0, 3, 2])
    first = np.r_[0, np.cumsum([len(g) for g in gaps])]
    gap = np.array(sum(gaps, []), np.int64)
    none = np.zeros(0, np.int64)
    node, bias, edge = rng.normal(size=len(gap)), -0.7, rng.normal(size=(2, 2))
    edge[0, 0] = 0.0
    chains = toxicity.Chains(first, gap, tail, none, none, np.zeros(0), none)
    log_z, p, expected = toxicity.forward_backward(chains, node, bias, edge, slopes=True)
    assert np.allclose(toxicity.forward_backward(chains, node, bias, edge)[0], log_z)
    pairs = [(0, 1), (1, 0), (1, 1)]
    for d in range(len(tail)):
        odds, which = [], []
        for i in range(first[d], first[d + 1]):
            odds += [bias] * int(gap[i]) + [node[i]]
            which += [-1] * int(gap[i]) + [i]
        odds, which = odds + [bias] * int(tail[d]), which + [-1] * int(tail[d])
        total, part, want = 0.0, np.zeros(len(odds)), np.zeros(4)
        for y in itertools.product((0, 1), repeat=len(odds)):
            steps = list(zip((0, *y), y, strict=False))
            w = np.exp(sum(o * v for o, v in zip(odds, y, strict=True)) + sum(edge[s] for s in steps))
            total += w
            part += w * np.array(y)
            want += w * np.array([sum(v for v, i in zip(y, which, strict=True) if i < 0), *(steps.count(k) for k in pairs)])
        assert np.isclose(np.log(total), log_z[d]) and np.allclose(want / total, expected[d])
        assert all(np.isclose(part[k] / total, p[i]) for k, i in enumerate(which) if i >= 0)


def test_words_learn_to_be_toxic_from_labelled_texts():
    rnd = random.Random(5)
    plain = ["blue", "river", "stone", "walks", "under", "green", "table", "seven", "light"]
    texts, toxic = [], []
    for i in range(300):
        words = [rnd.choice(plain) + rnd.choice(["", "s", "ing"]) for _ in range(rnd.randrange(5, 60))]
        if i % 4 == 0:
            words[rnd.randrange(len(words))] = rnd.choice(["zorkify", "zorkum", "Zorka", "zorkest", "grmpf"])
        texts.append(" ".join(words).encode())
        toxic.append(i % 4 == 0)
    tokens = toxicity.Tokens(texts)
    h, _ = tokens.features()
    wanted = np.unique(toxicity.Tokens([b"zorkify zorkum zorka zorkest grmpf river"]).features()[0])
    model = toxicity.Model(wanted, np.ones(len(wanted)), np.concatenate([np.zeros(toxicity.SHAPES), np.full(len(wanted), 3.0)]), -6.0)
    toxicity.fit(model, model.chains(tokens), np.array(toxic))
    seen = toxicity.Tokens([b"the green zorkish stone", b"under the river walks light", b"GRMPF", b"", b"12 !"])
    chains = model.chains(seen)
    log_z, p = toxicity.forward_backward(chains, model.node(chains), model.bias, model.edge)
    score = 1 - np.exp(-log_z)
    assert score[0] > 0.5 and score[2] > 0.5 and score[1] < 0.2 and score[3] == score[4] == 0
    assert chains.at[p.argmax()] in (2, 9) and set(wanted.tolist()) & set(h.tolist())


def test_spelling_sums_to_one():
    counts = np.zeros((pitman_yor.CONTEXTS, pitman_yor.SYMBOLS), np.int64)
    context, symbol, _ = pitman_yor.spelled([b"the", b"then", "é".encode(), b""])
    np.add.at(counts, (context, symbol), 1)
    p = pitman_yor.spelling_model(counts)
    assert np.allclose(p.sum(axis=1), 1) and (p > 0).all()
    assert p[context[0], ord("t")] > p[context[0], ord("q")]


def test_filters_hold_every_gram_and_decide():
    texts = {"en": b"the cat sat on the mat with the hat", "de": "der hund und die katze über den straßen".encode()}
    f = langid.Filters({k: np.unique(langid.grams([v])[0]) for k, v in texts.items()}, {"en": 2, "de": 1})
    for name, text in texts.items():
        assert (f.masks(langid.grams([text])[0]) >> np.uint64(f.names.index(name)) & np.uint64(1)).all()
    names, scores = f.decide([b"the hat", "die straßen".encode(), b"", b"123 !?", "½".encode(), b"A"])
    assert names[:4] == ["en", "de", "und", "und"] and names[4] == "und" and names[5] in ("en", "de")
    assert scores[2] == 0 and all(0 <= s <= 1 for s in scores)
    with pytest.raises(ValueError):
        langid.Filters({str(i): np.zeros(0) for i in range(70)}, {str(i): 1 for i in range(70)})


def test_notices_with_edits():
    s = license_scan.Scanner(license_scan.NOTICES)
    found = lambda t: [(x[0], x[3]) for x in s.find(b" ".join(license_scan.words_of(t)).decode("latin-1"))]
    assert ("apache-2.0", 0) in found(b"Licensed under the Apache License, Version 2.0.")
    assert ("apache-2.0", 2) in found(b"Licenced under teh Apache License, Version 2.0") or ("apache-2.0", 3) in found(b"Licenced under teh Apache License, Version 2.0")
    assert ("mit", 1) in found(b"Released under the MIT Licens.")
    assert found(b"nothing of the kind") == [] and found(b"") == []
    words = license_scan.words_of(b"CC BY cc-by, All rights\nreserved allrights reserved")
    assert license_scan.base_places(b" ".join(words), license_scan.word_starts(words)) == [(0, "cc-by"), (2, "cc-by"), (4, "reserved")]


def test_seeds_lose_no_notice():
    rnd = random.Random(4)
    s = license_scan.Scanner({"released under the mit license": ("mit", 2)})
    for _ in range(300):
        t = list("released under the mit license")
        for _ in range(rnd.randrange(3)):
            i = rnd.randrange(len(t))
            t[i] = rnd.choice(["x", "", t[i] + "z"]) if t[i] != " " else " "
        assert s.find("abc " + "".join(t) + " def"), "".join(t)


def test_shortages_go_to_siblings_first():
    have = {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "x"): 1000.0}
    got = mixing.allocate(200.0, have, lambda p: 1.0)
    assert got == {("a", "x"): 10.0, ("a", "y"): 90.0, ("b", "x"): 100.0}
    got = mixing.allocate(400.0, have, lambda p: 1.0)
    assert got == {("a", "x"): 10.0, ("a", "y"): 100.0, ("b", "x"): 290.0}
    assert sum(mixing.allocate(5000.0, have, lambda p: 1.0).values()) == 1110.0
    assert mixing.allocate(5.0, {}, lambda p: 1.0) == {} and mixing.fill(5.0, [(0.0, 3.0), (1.0, 2.0)]) == [0.0, 2.0]


def test_recordings_align_and_recall():
    rng = np.random.default_rng(0)
    vectors = rng.normal(0, 0.13, (30, 64))
    clean = [chroma.integers(chroma.chroma_frames(*chroma.read_wav(chroma.render(list(v))))) for v in vectors]
    found = 0
    for i, v in enumerate(vectors):
        rate, samples = chroma.read_wav(chroma.render(list(v)))
        noisy = np.concatenate([np.zeros(chroma.HOP * 7), samples]) + rng.normal(0, 0.02, len(samples) + chroma.HOP * 7)
        other = chroma.integers(chroma.chroma_frames(rate, noisy))
        offset, error, n = chroma.align(clean[i], other)
        found += offset == 7 and error <= chroma.MAX_ERROR and n >= chroma.MIN_OVERLAP
    assert found >= 27
    wrong = [chroma.align(a, b) for a, b in itertools.combinations(clean, 2)]
    assert not any(w and w[1] <= chroma.MAX_ERROR and w[2] >= chroma.MIN_OVERLAP for w in wrong)


def test_broken_media():
    assert chroma.read_wav(b"") is None and chroma.read_wav(b"RIFF" + b"x" * 60) is None
    assert len(chroma.integers(chroma.chroma_frames(8000, np.zeros(10)))) == 0
    silent = chroma.integers(chroma.chroma_frames(8000, np.zeros(40_000)))
    assert len(silent) and len(set(silent.tolist())) == 1


def test_crc_of_ids():
    assert zlib.crc32(b"12") % 4 in range(4)
