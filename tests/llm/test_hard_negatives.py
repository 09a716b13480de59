from __future__ import annotations

import math
import random

import numpy as np
import pytest

from footfall.llm import hard_negatives as hn
from footfall.llm.queries import QUERIES
from footfall.llm.statements import STATEMENTS
from tests.compare import connect, differences

SCHEMA = "vec_id bigint, embedding array<double>, label int, block int, id string, v string, score int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "x", "y", 2) for i, v, label in rows], SCHEMA)


def brute(rows, every, positives=5, negatives=3, low=50, high=95):
    usable = {}
    for key, vector, label in rows:
        if None in (key, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        whole = [max(-hn.LIMIT, min(hn.LIMIT, math.floor(x * hn.SCALE))) for x in vector]
        usable[key] = min(usable.get(key, (label, whole)), (label, whole))
    out = []
    for a, (label, v) in usable.items():
        if a % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w, strict=True)), i, other) for i, (other, w) in usable.items()
            if i != a and len(w) == len(v)
        )
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            inside = [s for s in scored if s[2] != label and -low * score <= -100 * s[0] <= -high * score]
            out += [(a, p, k + 1, i, -score, -s) for k, (s, i, _) in enumerate(inside[:negatives])]
    return sorted(out)


def random_rows(n, dim, labels, seed, whole=False):
    rng = random.Random(seed)
    draw = (lambda: rng.randrange(-2, 3) / 256) if whole else (lambda: rng.gauss(0.05, 0.3))
    return [(i, [draw() for _ in range(dim)], rng.randrange(labels)) for i in range(n)]


# Whole small numbers make many equal scores, so ties decide.
@pytest.mark.parametrize("rows", [random_rows(900, 13, 4, 1), random_rows(900, 5, 3, 2, whole=True), random_rows(60, 3, 40, 3)])
@pytest.mark.parametrize("block_bytes", [hn.BLOCK_BYTES, 4_000])
def test_against_brute_force(spark, monkeypatch, rows, block_bytes):
    monkeypatch.setattr(hn, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(hn, "GROUP", 7)
    got = hn.hard_negatives(frame(spark, rows), "id % 20 = 0")
    assert sorted(map(tuple, got.collect())) == brute(rows, 20)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        *random_rows(120, 4, 3, 5),
        (200, None, 1), (201, [1.0, None, 1.0, 1.0], 1), (202, [nan, 1.0, 1.0, 1.0], 1), (203, [inf, 1.0, 1.0, 1.0], 0),
        (None, [1.0] * 4, 1), (204, [1.0] * 4, None), (210, [0.0] * 4, 0), (220, [], 1), (221, [], 1), (222, [], 2),
        (230, [1e300, -1e300, 1.0, 0.5], 2), (240, [0.5] * 6, 1), (241, [0.5] * 6, 1), (242, [0.4] * 6, 2),
        (0, [9.0] * 4, 2), (10, [0.2] * 4, 1), (10, [0.2] * 4, 1),
    ]
    got = hn.hard_negatives(frame(spark, rows), "id % 10 = 0")
    want = brute(rows, 10)
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[0] == 240 for r in want) and any(r[0] == 220 for r in want)


def test_empty_tables(spark):
    assert hn.hard_negatives(frame(spark, []), "id % 10 = 0").collect() == []
    assert hn.hard_negatives(frame(spark, [(1, [1.0], 1)]), "id % 10 = 0").collect() == []
    assert hn.hard_negatives(frame(spark, [(10, [1.0], 1)]), "id % 10 = 0").collect() == []


def test_scan_drops_rows_before_the_last_column():
    rng = np.random.default_rng(4)
    columns = rng.normal(0, 4, (64, 2_000)).round().astype(np.int32)
    columns[:, :20] += 60
    anchor = np.full(64, 40, np.int64)
    left = []
    keep = hn.beaten(5)

    def counted(low, high):
        left.append(len(low))
        return keep(low, high)

    args = columns, columns.min(axis=1).astype(np.int64), columns.max(axis=1).astype(np.int64)
    rows, scores = hn.vertical_scan(*args, anchor, np.ones(2_000, bool), counted)
    exact = anchor @ columns.astype(np.int64)
    assert set(hn.best(exact, np.arange(2_000), 5)) <= set(rows) and (scores == exact[rows]).all()
    assert left[0] == 2_000 and left[-1] <= 20


def test_query_against_sql(spark, testdata):
    folder = f"{testdata}/sf0.01"
    df = QUERIES["op11_hard_negatives"](spark, folder)
    cursor = connect(folder).execute(STATEMENTS["op11_hard_negatives"])
    names = [d[0] for d in cursor.description]
    rows = [tuple(r) for r in df.collect()]
    assert rows and differences(df.columns, rows, names, cursor.fetchall()) is None
