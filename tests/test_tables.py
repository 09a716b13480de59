"""Sources, sinks and the whole chain from raw text to tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from footfall.operators import prompts
from footfall.plans import adapters
from footfall.plans.dataset import process_dataset
from footfall.session import scratch_folder
from footfall.sources import checkins, instructions, tables

HEADER = "User ID,Venue ID,Venue Category ID,Venue Category Name,Latitude,Longitude,Timezone Offset,UTC Time"


def test_latin1_and_quotes(spark, tmp_path):
    lines = [HEADER, 'u1,v1,c1,"Café, ""small""",40.7,-74.0,-240,Tue Apr 03 18:00:09 +0000 2012', "u2,v2,c2,Bar,x,,,bad"]
    (tmp_path / "raw.csv").write_bytes("\n".join(lines).encode("latin-1"))
    rows = checkins.read_checkins(spark, str(tmp_path / "raw.csv")).collect()
    assert rows[0].catname == 'Café, "small"' and rows[1].lat == "x" and rows[1].lon is None


def test_instruction_arrays_and_clamp(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"instruction": "i", "input": "x", "output": "1"}, {"instruction": "i", "input": "y\\nz", "output": "2"}]')
    read = lambda n: instructions.read_instructions(spark, str(tmp_path / "a.json"), n).collect()
    assert [r.input for r in read(None)] == ["x", "y\nz"]
    assert len(read(1)) == 1 and len(read(10)) == 2


def test_split_prefixes(spark):
    names = ["train_id.json", "val_x.json", "test_all_codebook.json", "test_codebook.json", "other.json"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(instructions.split_of_file(F.col("n"))).collect()] == ["train", "val", "test_all", "test", None]


def test_runs_are_appended_once(spark, tmp_path):
    path = str(tmp_path / "metrics")
    one = spark.createDataFrame([("a", 0.1, None, None, 0.2)], tables.METRIC_SCHEMA)
    two = spark.createDataFrame([("a", 0.9, None, None, 0.9), ("b", 0.3, 0.4, 0.5, 0.6)], tables.METRIC_SCHEMA)
    for runs in (one.unionByName(one), two, two.unionByName(two.withColumn("train_acc", F.lit(9.0)))):
        tables.append_new_runs(spark, runs, path)
    got = {r.run_name: r.train_acc for r in tables.read_runs(spark, path).collect()}
    assert got == {"a": 0.1, "b": 0.3} and tables.read_runs(spark, path).count() == 2


@pytest.mark.parametrize("with_recency", [False, True])
def test_whole_chain(spark, testdata, with_recency):
    raw = adapters.raw_checkins_ev(spark, f"{testdata}/sf0.01")
    data = process_dataset(raw, 5, 5, window_size=20, step_size=5, with_recency=with_recency)
    paths = tables.write_tables(data.tables(), scratch_folder(spark, "chain"), {"sequences": "split"})
    back = {p.rsplit("/", 1)[1]: spark.read.parquet(p) for p in paths}
    visits, meta = back["visits"], back["metadata"].first()
    assert visits.where("uid is null or pid is null or catname is null or region is null").isEmpty()
    assert visits.agg(F.count_distinct("uid")).first()[0] == meta.num_users == back["dictionary_uid"].count()
    assert back["profile"].where("segment = 0").count() == meta.num_pois
    widest = back["features"].agg(F.max("idx"), F.min("idx")).first()
    assert 0 <= widest[1] and widest[0] < meta.total_dim
    per_split = {r["split"]: r["count"] for r in back["sequences"].groupBy("split").count().collect()}
    assert set(per_split) == set(prompts.MODES)
    train = back["sequences"].where("split = 'train' and size(pids) = 19")
    assert not train.isEmpty()


def test_scratch_folders_go_with_their_context(spark):
    from footfall.session import scratch, staged

    with scratch(spark) as made:
        table = staged(spark.range(5).toDF("n"), "five")
        assert table.count() == 5 and tables.table_exists(spark, made[0])
    assert not tables.table_exists(spark, made[0])


def test_sparse_vectors(spark):
    from footfall.operators.features import ml_vectors, sparse_vectors

    rows = spark.createDataFrame([(1, 4, 1.0), (1, 0, 0.5), (2, 9, 1.0)], "pid int, idx bigint, value double")
    found = {r.pid: r.features for r in ml_vectors(sparse_vectors(rows, 10)).collect()}
    assert list(found[1].toArray()) == [0.5, 0, 0, 0, 1.0, 0, 0, 0, 0, 0] and found[2].indices.tolist() == [9]


def test_vectors_feed_machine_learning(spark):
    from pyspark.ml.clustering import KMeans

    from footfall.operators.features import ml_vectors, sparse_vectors

    rows = [(pid, (pid % 2) * 5 + k, 1.0) for pid in range(12) for k in range(3)]
    df = ml_vectors(sparse_vectors(spark.createDataFrame(rows, "pid int, idx bigint, value double"), 10))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found = KMeans(k=2, seed=1).fit(df).transform(df).collect()
    groups = {r.pid % 2: set() for r in found}
    for r in found:
        groups[r.pid % 2].add(r.prediction)
    assert len(groups[0]) == len(groups[1]) == 1 and groups[0] != groups[1]
    assert ml_vectors(sparse_vectors(spark.createDataFrame([], "pid int, idx bigint, value double"), 10)).count() == 0
