"""Split and sequences against brute force at every length where a rule changes."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from footfall.operators import sequences, splits

LENGTHS = [1, 2, 3, 9, 10, 11, 49, 50, 51, 59, 60, 61, 79, 80, 81, 95]
SCHEMA = "uid int, pid int, time timestamp_ntz, row_id bigint, row_block bigint"
START = datetime(2021, 3, 1)


def visits_of(lengths, same_time=False):
    rows, n = [], 0
    for uid, length in enumerate(lengths):
        for i in range(length):
            when = START if same_time else START + timedelta(hours=i)
            rows.append((uid, uid * 1000 + i, when, n, n // 5))
            n += 1
    return rows


@pytest.fixture(scope="module")
def frame(spark):
    rows = visits_of(LENGTHS)
    random.Random(2).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def text(t):
    return t.strftime("%Y-%m-%d %H:%M:%S")


def example(visits):
    return ([v[1] for v in visits[:-1]], [text(v[2]) for v in visits[:-1]], visits[-1][1], text(visits[-1][2]))


def groups():
    out = {}
    for r in visits_of(LENGTHS):
        out.setdefault(r[0], []).append(r)
    return out


def collected(df):
    return {(r.uid, r.seq_no): (r.pids, r.times, r.target, r.target_time) for r in df.collect()}


def test_train_without_masking(frame):
    want = {}
    for uid, g in groups().items():
        g = g[-80:]
        if 10 <= len(g) < 50:
            want[uid, 0] = example(g)
        for k, end in enumerate(range(len(g), 49, -10)):
            want[uid, k] = example(g[end - 50 : end])
    assert collected(sequences.train_sequences(frame, mask_prob=0.0)) == want


def test_masking_moves_one_visit(frame):
    plain = collected(sequences.train_sequences(frame, mask_prob=0.0))
    masked = collected(sequences.train_sequences(frame, mask_prob=1.0))
    assert plain.keys() == masked.keys()
    for key, (pids, times, target, when) in plain.items():
        got = masked[key]
        if len(pids) < 49:
            assert got == (pids, times, target, when)
            continue
        i = pids.index(got[2])
        assert got[3] == times[i]
        assert got[0] == pids[:i] + pids[i + 1 :] + [target]
        assert got[1] == times[:i] + times[i + 1 :] + [when]
    assert masked == collected(sequences.train_sequences(frame.repartition(7), mask_prob=1.0))


def test_mask_rate(spark):
    rows = spark.range(4000).select(F.col("id").cast("int").alias("uid"), F.lit(50).alias("end"))
    visit = F.struct(F.lit(1).alias("pid"))
    windows = rows.withColumns({"window": F.array_repeat(visit, 50), "inputs": F.array_repeat(visit, 49), "goal": visit})
    share = sequences.mask_augment(windows).agg(F.avg(F.col("masked").cast("int"))).first()[0]
    assert 0.08 < share < 0.12


def test_evaluation_examples(frame):
    test, val = {}, {}
    for uid, g in groups().items():
        n = len(g)
        if 2 < n < 50:
            test[uid, 0], val[uid, 0] = example(g), example(g[:-1])
        if n >= 50:
            test[uid, 0] = example(g[-50:])
        if n >= 51:
            val[uid, 0] = example(g[-51:-1])
    assert collected(sequences.test_examples(frame)) == test
    assert collected(sequences.val_examples(frame)) == val


@pytest.mark.parametrize("n", [0, 1, 4, 5, 23, 100])
@pytest.mark.parametrize("same_time", [False, True])
def test_split_point(spark, n, same_time):
    rows = visits_of([n], same_time) if n else []
    random.Random(n).shuffle(rows)
    marked = splits.time_split(spark.createDataFrame(rows, SCHEMA)).collect()
    first = {r[3] for r in sorted(rows, key=lambda r: (r[2], r[3]))[: int(0.8 * n)]}
    assert {r.row_id for r in marked if r.is_train} == first
    assert len(marked) == n


def test_cold_rows_drop(spark):
    train = spark.createDataFrame([(1, 10), (2, 20)], "uid int, pid int")
    test = spark.createDataFrame([(1, 20), (1, 30), (3, 10)], "uid int, pid int")
    assert [tuple(r) for r in splits.drop_cold_test_rows(train, test).collect()] == [(1, 20)]


def test_all_splits_are_named(frame):
    train, test = splits.split_data(frame.withColumn("pid", F.col("pid") % 5))
    got = {r.split for r in sequences.generate_sequences(train, test).select("split").distinct().collect()}
    assert got == {"train", "val", "test", "test_all"}


@pytest.mark.parametrize(("window", "mask"), [(50, 0.0), (50, 1.0), (7, 0.3), (90, 0.0)])
def test_all_splits_from_one_row_for_each_user(frame, window, mask):
    train, test = frame.where("row_id % 3 <> 0"), frame.where("row_id % 3 = 0")
    found = sequences.generate_sequences(train, test, window, 10, mask).cache()
    wanted = {
        "train": sequences.train_sequences(train, window, 10, mask),
        "val": sequences.val_examples(test, window),
        "test": sequences.test_examples(test, window),
        "test_all": sequences.test_examples(splits.union_train_test(train, test), window),
    }
    for split, df in wanted.items():
        assert collected(found.where(F.col("split") == split)) == collected(df)


def test_visits_are_shuffled_once_for_all_splits(frame):
    plan = sequences.generate_sequences(frame, frame)._jdf.queryExecution().executedPlan().toString()
    # The visits by user and part after their limit, then one row for each user and part.
    assert plan.count("Exchange hashpartitioning") == 2 and plan.rindex("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_history_is_cut_before_the_shuffle(frame):
    plan = sequences.cap_history(frame)._jdf.queryExecution().executedPlan().toString()
    before = plan[plan.index("Exchange") :]
    assert "WindowGroupLimit" in before and "Partial" in before
