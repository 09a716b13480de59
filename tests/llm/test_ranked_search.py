from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from footfall.llm import ranked_search as rs
from footfall.llm.queries import QUERIES
from footfall.llm.statements import STATEMENTS
from tests.compare import connect, differences
from tests.llm.conftest import ODD_TEXTS

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def found_terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k=20):
    counted = [(key, Counter(found_terms(text))) for key, text in docs]
    held = [(key, c, c.total()) for key, c in counted if c]
    n_docs, all_terms = len(held), sum(n for _, _, n in held)
    frequency = Counter(term for _, c, _ in held for term in c)
    rows = []
    best = {}
    for item, text in items:
        if item is not None:
            best[item] = min((t for t in (best.get(item), text) if t is not None), default=None)
    for item, text in best.items():
        asked = Counter(found_terms(text))
        scored = []
        for key, c, n in held:
            m = 75 + 25 * n * n_docs // all_terms
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t, times in asked.items() if t in c
            )
            if score > 0:
                scored.append((-score, key is None, key or 0))
        rows += [(item, r + 1, None if missing else key, -s) for r, (s, missing, key) in enumerate(sorted(scored)[:k])]
    return sorted(rows, key=str)


def frames(spark, docs_of, docs, items):
    return docs_of(docs), spark.createDataFrame([(i, t, "x", 3) for i, t in items], "item_id bigint, text string, term string, doc int")


WORDS = ["alpha", "beta", "Gamma", "delta7", "ünï", "日本", "x", "42", "eps"]


def random_docs(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12)))) for i in range(n)]


ITEMS = [(1, "Alpha beta, beta"), (2, "ÜNÏ ünï nothing"), (3, "日本 42 X eps-eps"), (4, ""), (5, None), (6, "absent"), (7, "gamma " * 9)]


@pytest.mark.parametrize("documents", [rs.DOCUMENTS, 7])
def test_against_brute_force(spark, docs_of, monkeypatch, documents):
    monkeypatch.setattr(rs, "DOCUMENTS", documents)
    monkeypatch.setattr(rs, "ITEMS", 3)
    docs = random_docs(300, 1)
    got = rs.ranked_search(*frames(spark, docs_of, docs, ITEMS), k=9)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, ITEMS, 9)


def test_odd_texts_keys_and_items(spark, docs_of):
    docs = [*ODD_TEXTS, (None, "one two"), (4, "one two three"), (4, "one two three")]
    items = [(1, "one two words"), (1, "zzz"), (None, "one"), (2, "a" * 70_000), (3, ODD_TEXTS[7][1]), (3, ODD_TEXTS[7][1])]
    got = rs.ranked_search(*frames(spark, docs_of, docs, items))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items)


def test_empty_tables(spark, docs_of):
    assert rs.ranked_search(*frames(spark, docs_of, [], ITEMS)).collect() == []
    assert rs.ranked_search(*frames(spark, docs_of, random_docs(5, 2), [])).collect() == []
    assert rs.ranked_search(*frames(spark, docs_of, [(1, None), (2, " ")], ITEMS)).collect() == []


def test_several_rounds_of_items(spark, docs_of, monkeypatch):
    monkeypatch.setattr(rs, "VOCABULARY_BYTES", 30)
    docs = random_docs(80, 3)
    got = rs.ranked_search(*frames(spark, docs_of, docs, ITEMS))
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, ITEMS)


def test_tiles_stay_below_exact_sums():
    # Weights so large that a few columns fill a tile.
    weights = np.array([30_000] * 50)
    times = {n: 20_000 + n for n in range(50)}
    tile = rs.ItemTile([(1, times), (2, {3: 1})], weights)
    assert len(tile.cuts) > 3
    for start, end in zip(tile.cuts, tile.cuts[1:]):
        assert (tile.matrix[:, start:end].sum(axis=1) * rs.IMPACT).max() < rs.EXACT
    impacts = np.full((50, 2), 999_999.0)
    want = sum(30_000 * t for t in times.values()) * 999_999
    assert tile.scores(impacts)[0].tolist() == [want, want]


def test_equal_scores_are_cut_by_key():
    top = rs.TopRows(1, 3)
    top.add(np.array([[5, 5, 0, 5, 7]]), [9, 4, 1, 8, 6])
    top.add(np.array([[5, 5]]), [2, None])
    assert list(top.out([11])) == [(11, 6, 7), (11, 2, 5), (11, 4, 5)]


def test_query_against_sql(spark, testdata):
    folder = f"{testdata}/sf0.01"
    df = QUERIES["op12_ranked_search"](spark, folder)
    cursor = connect(folder).execute(STATEMENTS["op12_ranked_search"])
    names = [d[0] for d in cursor.description]
    rows = [tuple(r) for r in df.collect()]
    assert rows and differences(df.columns, rows, names, cursor.fetchall()) is None
