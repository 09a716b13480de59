"""Records of files in file order, wherever the files are split."""

from __future__ import annotations

import csv
import gzip
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from footfall.operators import graph
from footfall.session import scratch
from footfall.sources import checkins, instructions
from footfall.sources.records import JsonObjects, QuotedLines, records

HEADER = ["User ID", "Venue ID", "Venue Category ID", "Category", "Latitude", "Longitude", "Offset", "UTC Time"]
ODD = ["Café", "a\nb", 'x, "y"\r\nz\n\n', '5" pipe', "plain", "", '"', "{", "}]", "\\", "long " * 40 + "\n" * 3, ' "quoted" ']


@pytest.fixture(params=["128m", "10000", "700", "97"])
def split_size(spark, request):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    spark.conf.set(names[0], request.param)
    spark.conf.set(names[1], "4m" if request.param == "128m" else "0")
    yield request.param
    for name, value in before.items():
        spark.conf.set(name, value)


def write_csv(path, rows):
    with open(path, "w", encoding="latin-1", newline="") as f:
        writer = csv.writer(f, lineterminator="\r\n")
        writer.writerow(HEADER)
        writer.writerows(rows)


def test_checkins_in_file_order(spark, tmp_path, split_size):
    rng = random.Random(1)
    rows = [[f"u{i % 7}", f"v{i}", "c", rng.choice(ODD), str(i), "2", "0", "t"] for i in range(300)]
    write_csv(tmp_path / "a.csv", rows[:200])
    write_csv(tmp_path / "b.csv", rows[200:])
    with open(tmp_path / "b.csv", "ab") as f:
        # A quote inside an unquoted field, a blank line, text behind a closing quote, and no line break at the end.
        f.write(b'u9,v300,c,5" pipe and "more,300,2,0,t\r\n\r\nu9,v301,c,"x"y,301,2,0,t')
    got = checkins.read_checkins_in_order(spark, str(tmp_path)).orderBy("row_id").collect()
    parts = [pd.read_csv(tmp_path / f"{n}.csv", encoding="latin-1", dtype=str, keep_default_na=False) for n in "ab"]
    want = [tuple(x or None for x in row) for row in pd.concat(parts).itertuples(index=False)]
    # What stands behind a closing quote is kept by one parser with the quotes and by the other without.
    clean = lambda row: tuple(x.replace('"', "") if x and x.endswith("y") and "x" in x else x for x in row)
    assert [clean(tuple(x or None for x in r[:8])) for r in got] == [clean(row) for row in want]
    assert len({r.row_id for r in got}) == len(got)
    blocks = [r.row_block for r in got]
    assert blocks == sorted(blocks) and (split_size == "128m") == (len(set(blocks)) == 2)


def test_places_of_users_follow_the_file(spark, tmp_path, split_size):
    rng = random.Random(2)
    rows = [[f"u{rng.randrange(5)}", str(rng.randrange(30)), "c", "x\ny", "1", "2", "0", "t"] for _ in range(200)]
    write_csv(tmp_path / "a.csv", rows)
    raw = checkins.read_checkins_in_order(spark, str(tmp_path / "a.csv"))
    got = {r.uid: r.pids for r in graph.user_place_sequence(raw).collect()}
    want = {}
    for row in rows:
        want.setdefault(row[0], []).append(row[1])
    assert got == want


def test_a_quote_left_open_keeps_the_rest(spark, tmp_path, split_size):
    (tmp_path / "a.csv").write_bytes(b'h\n1,a\n2,"open\n' + b"3,b\n" * 300)
    (tmp_path / "b.csv").write_bytes(b"h\n4,c\n")
    found = [bytes(r.body) for r in records(spark, str(tmp_path), QuotedLines()).orderBy("row_id").collect()]
    assert found[:2] == [b"h", b"1,a"] and found[-2:] == [b"h", b"4,c"]
    assert found[2] == b'2,"open\n' + b"\n".join([b"3,b"] * 300) and len(found) == 5


def examples(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice([*ODD, "ünï 日本 🎉", '\\"', "/", "\t"]) for _ in range(rng.randrange(4)))
    return [{"instruction": text(), "input": text(), "output": str(i)} for i in range(n)]


@pytest.mark.parametrize("form", ["pandas", "compact", "indented", "lines"])
def test_arrays_in_file_order(spark, tmp_path, split_size, form):
    rows = examples(250, 3)
    text = {
        "pandas": lambda: pd.DataFrame(rows).to_json(orient="records", indent=4),
        "compact": lambda: json.dumps(rows, separators=(",", ":"), ensure_ascii=False),
        "indented": lambda: "\n\n " + json.dumps(rows, indent=2, ensure_ascii=False) + "\n\n",
        "lines": lambda: "\n".join(json.dumps(row) for row in rows),
    }[form]()
    (tmp_path / "train_codebook.json").write_text(text)
    (tmp_path / "val_codebook.json").write_text("[]")
    got = instructions.read_instruction_arrays(spark, str(tmp_path / "*.json")).orderBy("row_id").collect()
    assert [[r.instruction, r.input, r.output] for r in got] == [list(row.values()) for row in rows]
    first = instructions.read_instructions(spark, str(tmp_path / "train_codebook.json"), max_examples=40).collect()
    assert sorted(int(r.output) for r in first) == list(range(40))


def test_nested_objects_stay_whole(spark, tmp_path, split_size):
    rows = [{"k": i, "in": {"a": [{"b": "}{"}] * (i % 4), "c": {}}, "s": '"}' * (i % 3)} for i in range(120)]
    (tmp_path / "n.json").write_text(json.dumps(rows))
    found = records(spark, str(tmp_path / "n.json"), JsonObjects()).select("row_id", JsonObjects.text(F.col("body")).alias("t"))
    got = [r.t for r in found.where("t is not null").orderBy("row_id").collect()]
    assert [json.loads(t) for t in got] == rows


def test_array_files(spark, tmp_path, monkeypatch):
    rows = examples(120, 4)
    df = spark.createDataFrame([(i, *row.values()) for i, row in enumerate(rows)], "i int, instruction string, input string, output string")
    path = instructions.write_instruction_array(df.repartition(5), str(tmp_path / "one"), "train", "codebook", order=["i"])
    assert path.endswith("/train_codebook.json")
    with open(path, encoding="utf-8") as f:
        assert json.load(f) == rows
    with pytest.raises(FileExistsError):
        instructions.write_instruction_array(df, str(tmp_path / "one"), "train", "codebook", order=["i"])
    monkeypatch.setattr(instructions, "ARRAY_FILE_BYTES", 1_000)
    folder = instructions.write_instruction_array(df, str(tmp_path / "many"), "test", "id", with_time=False, order=["i"])
    files = sorted((tmp_path / "many" / "test_id_notime.json").glob("part-*"))
    assert len(files) > 3 and [x for f in files for x in json.loads(f.read_text("utf-8"))] == rows
    back = instructions.read_instruction_arrays(spark, folder).orderBy("row_id").collect()
    assert [r.output for r in back] == [row["output"] for row in rows]
    monkeypatch.undo()
    empty = instructions.write_instruction_array(df.where("i < 0"), str(tmp_path / "one"), "val", "codebook", order=["i"])
    with open(empty, encoding="utf-8") as f:
        assert json.load(f) == []
    splits = {r["split"]: r["count"] for r in instructions.read_instruction_folder(spark, str(tmp_path / "one")).groupBy("split").count().collect()}
    assert splits == {"train": 120}


def test_compressed_array_files(spark, tmp_path, monkeypatch):
    rows = examples(120, 4)
    df = spark.createDataFrame([(i, *row.values()) for i, row in enumerate(rows)], "i int, instruction string, input string, output string")
    for name, bound in (("one", None), ("many", 1_000)):
        if bound:
            monkeypatch.setattr(instructions, "ARRAY_FILE_BYTES", bound)
        with scratch(spark) as made:
            path = instructions.write_instruction_array(
                df.repartition(5), str(tmp_path / name), "train", "codebook", order=["i"], compression="gzip", written=True
            )
            # Rows of a written table are not written once more.
            assert not any("/records-" in folder for folder in made)
        files = sorted((tmp_path / name / "train_codebook.json").glob("part-*"))
        assert (len(files) > 3) == bool(bound) and all(f.name.endswith(".gz") for f in files)
        assert [x for f in files for x in json.loads(gzip.decompress(f.read_bytes()))] == rows
        back = instructions.read_instruction_arrays(spark, path).orderBy("row_id").collect()
        assert [(r.instruction, r.input, r.output) for r in back] == [tuple(row.values()) for row in rows]
    empty = instructions.write_instruction_array(df.where("i < 0"), str(tmp_path / "one"), "val", "codebook", order=["i"], compression="gzip")
    assert instructions.read_instruction_arrays(spark, empty).count() == 0
    splits = {r["split"]: r["count"] for r in instructions.read_instruction_folder(spark, str(tmp_path / "one")).groupBy("split").count().collect()}
    assert splits == {"train": 120}
