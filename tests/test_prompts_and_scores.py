from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from footfall.operators import prompts, scoring

SEQ = "split string, uid int, seq_no int, pids array<int>, times array<string>, target int, target_time string"


def seqs(spark, rows):
    return spark.createDataFrame(rows, SEQ)


def test_prompt_texts(spark):
    rows = [
        ("train", 5, 0, [1, 2], ["t1", "t2"], 1, "t3"),
        ("train", 6, 0, [2], ["t1"], 2, "t2"),
        ("train", 7, 0, [1, 2], [], 2, "t2"),
    ]
    book = spark.createDataFrame([(1, [4, 17]), (2, [0, 3])], "pid int, codes array<int>")
    tokens = prompts.sequence_to_sids(seqs(spark, rows), book)
    timed = {r.uid: r for r in prompts.prompt_with_time(tokens).collect()}
    assert timed[5].input == "User_5 visited: <a_4><b_17> at t1, <a_0><b_3> at t2. When t3 user_5 is likely to visit:"
    assert timed[5].output == "<a_4><b_17>"
    assert timed[6].input == "User_6 visited: <a_0><b_3> at t1. When t2 user_6 is likely to visit:"
    assert timed[7].input == "User_7 visited: <a_4><b_17> <a_0><b_3> When t2 user_7 is likely to visit:"
    plain = {r.uid: r.input for r in prompts.prompt_no_time(tokens).collect()}
    assert plain[5] == "The user_5 visited: <a_4><b_17>, <a_0><b_3>, and in the next time user_5 is likely to visit:"
    assert plain[6] == "The user_6 visited: <a_0><b_3>, and in the next time user_6 is likely to visit:"
    ids = {r.uid: r for r in prompts.sequence_to_ids(seqs(spark, rows)).collect()}
    assert ids[5].tokens == ["<1>", "<2>"] and ids[5].target_token == "<1>"


def test_large_codebooks_are_joined(spark, monkeypatch):
    rows = [(u, [u % 5 + 1, 2, 3], u % 3 + 1) for u in range(40)]
    book = spark.createDataFrame([(p, [p, p + 1]) for p in range(1, 8)], "pid int, codes array<int>")
    df = spark.createDataFrame(rows, "uid int, pids array<int>, target int").selectExpr("'train' as split", "uid", "0 as seq_no", "pids", "target")
    held = prompts.sequence_to_sids(df, book)
    monkeypatch.setattr(prompts, "SHIPPED_PLACES", 3)
    joined = prompts.sequence_to_sids(df, book)
    assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert held.columns == joined.columns
    assert sorted(map(tuple, held.collect()), key=str) == sorted(map(tuple, joined.collect()), key=str)
    assert prompts.sequence_to_sids(df.where("uid < 0"), book).count() == 0


def test_many_places_with_few_ids_are_not_joined(spark, monkeypatch):
    book = spark.range(600_000).selectExpr("id as pid", "array(int(id % 4), int(id % 3)) as codes")
    df = seqs(spark, [("train", 1, 0, [599_999, 7], ["a", "b"], 500_002, "c")])
    held = prompts.sequence_to_sids(df, book)
    assert "Join" not in held._jdf.queryExecution().executedPlan().toString()
    assert held.first().tokens == ["<a_3><b_2>", "<a_3><b_1>"] and held.first().target_token == "<a_2><b_1>"
    monkeypatch.setattr(prompts, "SHIPPED_SIDS", 3)
    joined = prompts.sequence_to_sids(df, book.where("pid < 40 or pid > 500000"))
    assert "Join" in joined._jdf.queryExecution().executedPlan().toString()
    assert joined.select("tokens", "target_token").collect() == held.select("tokens", "target_token").collect()


def test_joined_places_are_looked_up_once_for_each_user(spark, monkeypatch):
    monkeypatch.setattr(prompts, "SHIPPED_PLACES", 3)
    book = spark.createDataFrame([(p, [p, p + 1]) for p in range(1, 8)], "pid int, codes array<int>")
    rows = [("train", u, k, [1, 2, 2, k + 3], 7) for u in (1, 2, None) for k in range(3)] * 2
    df = spark.createDataFrame(rows, "split string, uid int, seq_no int, pids array<int>, target int")
    got = prompts.sequence_to_sids(df, book)
    assert "posexplode" not in got._jdf.queryExecution().executedPlan().toString()
    sid = {p: f"<a_{p}><b_{p + 1}>" for p in range(1, 8)}
    want = [(*r, [sid[p] for p in r[3]], sid[r[4]]) for r in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    with pytest.raises(Exception, match="no codes for place 9"):
        prompts.sequence_to_sids(df.withColumn("target", F.lit(9)), book).collect()


def test_unknown_place_is_an_error(spark):
    book = spark.createDataFrame([(1, [4])], "pid int, codes array<int>")
    with pytest.raises(Exception, match="no codes for place 9"):
        prompts.sequence_to_sids(seqs(spark, [("train", 1, 0, [1, 9], ["a", "b"], 1, "c")]), book).collect()


def test_prompt_completion(spark):
    df = spark.createDataFrame([("I", "in", "out")], "instruction string, input string, output string")
    assert tuple(prompts.prompt_completion(df).first()) == ("I\nin ", "out")


def words_of(text):
    found = list(re.finditer(r"\S+", text))
    return [hash_id(m.group()) for m in found], [m.start() for m in found]


def hash_id(word):
    import hashlib

    return int(hashlib.md5(word.encode()).hexdigest()[:7], 16)


def test_masking_agrees_with_offsets(spark):
    rows = [("a b ", "c d"), ("a b", "c d"), ("", "x"), (" lead  gap ", ""), ("w " * 30, "y z")]
    df = spark.createDataFrame(rows, "prompt string, completion string")
    builtin = {(r.prompt, r.completion): (r.input_ids, r.labels) for r in prompts.mask_prompt_labels(df, max_length=20).collect()}
    hooked = {(r.prompt, r.completion): (r.input_ids, r.labels) for r in prompts.mask_prompt_labels_by(df, words_of, max_length=20).collect()}
    assert builtin == hooked
    ids, labels = builtin["a b ", "c d"]
    assert labels[:2] == [-100, -100] and labels[2:] == ids[2:] and len(ids) == 4


def test_length_stats_use_the_upper_median(spark):
    df = spark.createDataFrame([(" ".join("x" * n),) for n in (1, 2, 150, 250)], "text string")
    lengths = prompts.token_lengths(df)
    assert tuple(prompts.token_length_stats(lengths).first()) == (4, 1, 250, 100.75, 150)
    assert sorted(map(tuple, prompts.token_length_histogram(lengths).collect())) == [(0, 2), (100, 1), (200, 1)]


PROMPT = "split string, uid int, seq_no int, prompt string, completion string"


def test_user_and_sids(spark):
    df = spark.createDataFrame(
        [("test", 1, 0, "USER_12 visited: <A_1><B_2> at x, <a_1><b_2>. user_13", "<c_9>")], PROMPT
    )
    row = prompts.extract_user_sids(df).first()
    assert row.user == "user_12" and sorted(row.sids) == ["<a_1><b_2>", "<c_9>"]


def test_cold_prompts(spark):
    train = spark.createDataFrame([("train", 1, 0, "user_1 <a_1>", "<a_2>"), ("train", 2, 0, "user_2 <a_3>", "<a_1>")], PROMPT)
    test = spark.createDataFrame(
        [
            ("test", 1, 0, "user_1 <a_3>", "<a_2>"),
            ("test", 2, 0, "user_2 <a_1>", "<a_9>"),  # unseen only in the completion
            ("test", 3, 0, "user_3 <a_1>", "<a_1>"),
            ("test", 1, 1, "user_1 <a_9>", "<a_9>"),
        ],
        PROMPT,
    )
    kept = prompts.filter_cold_prompts(test, train, prompts.SEQUENCE_KEY).collect()
    assert [(r.uid, r.seq_no) for r in kept] == [(1, 0)]
    found = {(r.kind, r.value) for r in prompts.collect_users_sids(train).collect()}
    assert found == {("user", "user_1"), ("user", "user_2"), ("sid", "<a_1>"), ("sid", "<a_2>"), ("sid", "<a_3>")}


def test_variants(spark):
    models = spark.createDataFrame([("NYC", "m1", True), ("NYC", "m2", False)], "dataset string, model string, has_notime boolean")
    rows = prompts.variant_matrix(models).collect()
    assert len(rows) == 4 + 2 * 4 + 4
    assert {r.file_name for r in rows if r.model == "m1"} == {
        f"{m}_codebook{s}.json" for m in prompts.MODES for s in ("", "_notime")
    }
    assert {r.file_name for r in rows if r.kind == "id"} == {f"{m}_id.json" for m in prompts.MODES}


def test_attempts(spark):
    rows = [("p", i, t) for i, t in enumerate([" ", "", "  ", "", " ", "late"])] + [("q", 0, ""), ("q", 1, " hit "), ("q", 2, "no")]
    df = spark.createDataFrame(rows, "k string, attempt int, text string")
    assert dict(map(tuple, scoring.first_nonempty_attempt(df, ["k"]).collect())) == {"p": "", "q": "hit"}


def test_accuracy_contains_and_log_equals(spark):
    df = spark.createDataFrame([("<a_1>", "1><b_2>"), ("<a_1>", "2>"), ("<a_1>", "")], "gold string, result string")
    row = scoring.top1_accuracy(df).first()
    assert row.examples == 3 and math.isclose(row.accuracy, 1 / 3)
    log = scoring.prediction_log(df.select("gold", F.concat(F.lit("<a_"), "result").alias("prediction"))).collect()
    assert [r.correct for r in log] == [False, False, False]


def test_true_zero_is_not_missing(spark):
    df = spark.createDataFrame([("r", 0.0, None, 0.25, 1.0)], "run_name string, train_acc double, val_acc double, test_all_acc double, test_acc double")
    assert tuple(scoring.format_metrics(df).first()) == ("r", "0.0000", "-", "0.2500", "1.0000")


def test_predictor_hook(spark):
    df = spark.createDataFrame([("p1",), ("p2",)], "prompt string")
    got = scoring.batch_predict(df, lambda texts: [t.upper() for t in texts]).collect()
    assert sorted(map(tuple, got)) == [("p1", "P1<A_"), ("p2", "P2<A_")]


def test_early_stop(spark):
    losses = [3.0, 2.0, 2.0, 2.5, 2.1, 1.0]  # best at 2, plateau, stop at 5; the later improvement is never reached
    df = spark.createDataFrame([("r", i + 1, x) for i, x in enumerate(losses)] + [("s", 1, None)], "run string, epoch int, eval_loss double")
    rows = scoring.best_epoch_early_stop(df).orderBy("run", "epoch").collect()
    assert [(r.epoch, r.improved, r.best_epoch, r.stopped) for r in rows if r.run == "r"] == [
        (1, True, 1, False), (2, True, 2, False), (3, False, 2, False), (4, False, 2, False), (5, False, 2, True),
    ]
    assert [(r.improved, r.best_epoch) for r in rows if r.run == "s"] == [(False, 0)]


def test_perplexity(spark):
    df = spark.createDataFrame([(0.0, None), (1.0, 7.0)], "eval_loss double, perplexity double")
    assert [r.perplexity for r in scoring.with_perplexity(df).collect()] == [1.0, 7.0]
    assert scoring.with_perplexity(df.drop("perplexity")).collect()[1].perplexity == pytest.approx(math.e)


def test_attempts_lose_white_space_of_any_kind(spark):
    tries = ["\n", "\t4>", " \n5>\n", "\u00a0\u2003 ", "\x1c6>\x1f"]
    df = spark.createDataFrame([(k, i, t) for i, t in enumerate(tries) for k in ("a",)], "k string, attempt int, text string")
    assert scoring.first_nonempty_attempt(df, ["k"]).first().result == "4>"
    for i, want in ((0, ""), (2, "5>"), (3, ""), (4, "6>")):
        one = df.where(F.col("attempt") == i).withColumn("attempt", F.lit(0))
        assert scoring.first_nonempty_attempt(one, ["k"]).first().result == want == tries[i].strip()


def test_prompts_without_a_user_are_cold(spark):
    rows = [(1, 1, "user_1 was at <a>", "<a>"), (2, 1, "nobody was at <a>", "<a>")]
    df = spark.createDataFrame(rows, "uid int, seq_no int, prompt string, completion string").withColumn("split", F.lit("test"))
    assert [r.user for r in prompts.extract_user_sids(df).orderBy("uid").collect()] == ["user_1", None]
    assert {r.value for r in prompts.collect_users_sids(df).collect()} == {"user_1", "<a>"}
    assert [r.uid for r in prompts.filter_cold_prompts(df, df, ["uid", "seq_no"]).collect()] == [1]
