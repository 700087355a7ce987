"""Similarity of names: Column expressions where SQL has them, Arrow UDFs elsewhere."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import tokens


def edit_similarity(a: Column, b: Column) -> Column:
    """SIM-02: 1 - Levenshtein distance / longer length; two empty names are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longer)


def token_jaccard(a: Column, b: Column) -> Column:
    """SIM-03 of token arrays: two empty ones are alike, one empty is not."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def combined(a: Column, b: Column, a_tokens: Column | None = None, b_tokens: Column | None = None) -> Column:
    """SIM-04: 0.4 edit similarity in lower case + 0.6 token Jaccard."""
    jaccard = token_jaccard(tokens(a) if a_tokens is None else a_tokens, tokens(b) if b_tokens is None else b_tokens)
    return 0.4 * edit_similarity(F.lower(a), F.lower(b)) + 0.6 * jaccard


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, 64 or more cells a step in one integer."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = (state + hit | state - hit) & full
    return len(a) - state.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """0..100: one minus insertions and deletions over the total length."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * common_length(a, b) / total


def sorted_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _set_forms(a: str, b: str) -> tuple[str, str, str] | None:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return None
    both = " ".join(sorted(x & y))
    forms = [" ".join(p for p in (both, " ".join(sorted(only))) if p) for only in (x - y, y - x)]
    return both, *forms


def set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared tokens, and those with either side's others."""
    forms = _set_forms(a, b)
    if forms is None:
        return 0.0
    both, first, second = forms
    if both and both in (first, second):
        return 100.0
    return max(indel_ratio(first, second), *((indel_ratio(both, first), indel_ratio(both, second)) if both else (0.0,)))


def set_ratio_matching_blocks(a: str, b: str) -> float:
    """SIM-07: the same three strings by matching blocks, 0..1."""
    forms = _set_forms(a, b)
    if forms is None:
        return 0.0
    pairs = ((forms[0], forms[1]), (forms[0], forms[2]), (forms[1], forms[2]))
    return max(difflib.SequenceMatcher(None, p, q).ratio() for p, q in pairs if p and q) if any(p and q for p, q in pairs) else 0.0


def winkler(a: str, b: str) -> float:
    """SIM-08: Jaro-Winkler, 0..1, prefix weight 0.1 for at most 4 characters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    theirs = [b[j] for j in range(len(b)) if used[j]]
    m = len(mine)
    if not m:
        return 0.0
    swaps = sum(p != q for p, q in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    start = 0
    while start < min(4, len(a), len(b)) and a[start] == b[start]:
        start += 1
    return jaro + start * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def _udf(of):
    @F.pandas_udf("double")
    def apply(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(of(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return apply


def token_sort_ratio(a: Column, b: Column) -> Column:
    """SIM-05."""
    return _udf(sorted_ratio)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """SIM-06."""
    return _udf(set_ratio)(a, b)


def token_set_blocks(a: Column, b: Column) -> Column:
    """SIM-07."""
    return _udf(set_ratio_matching_blocks)(a, b)


def jaro_winkler(a: Column, b: Column) -> Column:
    """SIM-08 in lower case."""
    return _udf(winkler)(F.lower(a), F.lower(b))


def unsafe_subset(query: Column, choice: Column) -> Column:
    """SIM-09: a choice of one or two tokens, all in a query of at least twice as many."""
    q, c = (F.array_distinct(F.filter(F.split(F.lower(x), r"\s+"), lambda w: w != "")) for x in (query, choice))
    return (F.size(c) <= 2) & (F.size(F.array_except(c, q)) == 0) & (F.size(q) > F.size(c)) & (F.size(q) >= 2 * F.size(c))


def search_score(name_share: Column, city_share: Column, state: Column, root: Column, keyword: Column) -> Column:
    """SIM-10: 0..100."""
    score = 50 * name_share + 20 * city_share + 10 * state.cast("int") + 15 * root.cast("int") + 5 * keyword.cast("int")
    return F.least(F.floor(score), F.lit(100)).cast("int")


def site_confidence(status: Column, logo: Column, socials: Column, staff: Column) -> Column:
    """SIM-11: 0..100."""
    score = 20 + 25 * logo.cast("int") + F.least(10 * socials, F.lit(30)) + 15 * staff.cast("int")
    return F.when(status != "active", F.lit(10)).otherwise(F.least(score, F.lit(100))).cast("int")


def path_confidence(path: Column, strong: list[str], weak: list[str]) -> Column:
    """SIM-12: 1.0 for a strong path, 0.7 for a weak one, else 0.5."""
    def hit(words):
        out = F.lit(False)
        for w in words:
            out = out | F.contains(F.lower(path), F.lit(w))
        return out

    return F.when(hit(strong), 1.0).when(hit(weak), 0.7).otherwise(0.5)


def anchor_score(path_hit: Column, text: Column, wanted: str, other: str, combined_page: Column) -> Column:
    """SIM-13: 10 for a path hit, 5 more or less by gender, 1 less for a page of both; 1 for text alone."""
    gender = F.when(F.contains(F.lower(text), F.lit(wanted)), 5).when(F.contains(F.lower(text), F.lit(other)), -5).otherwise(0)
    return F.when(path_hit, 10 + gender - combined_page.cast("int")).when(F.lower(text).rlike("soccer"), 1).otherwise(0)
