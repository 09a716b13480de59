"""The registered queries and the pipeline as a whole."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from footfall.llm import bpe, quality
from footfall.llm.queries import QUERIES
from footfall.llm.statements import STATEMENTS
from tests.compare import connect, differences
from tests.llm import brute
from tests.llm.conftest import ODD_TEXTS


def test_one_query_for_each_operator():
    assert sorted(k.split("_")[0] for k in QUERIES) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])


@pytest.mark.parametrize("key", sorted(STATEMENTS))
def test_same_rows_as_sql(spark, testdata, key):
    sf_dir = f"{testdata}/sf0.001"
    df = QUERIES[key](spark, sf_dir)
    cursor = connect(sf_dir).execute(STATEMENTS[key])
    names = [d[0] for d in cursor.description]
    assert differences(df.columns, [tuple(r) for r in df.collect()], names, cursor.fetchall()) is None


def test_pipeline_against_brute_force(spark, testdata):
    sf_dir = f"{testdata}/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    rows = {r.doc_id: (r.text, r.source) for r in docs if quality.judge(r.text)[6]}
    gone = brute.repeated_lines([(d, t) for d, (t, _) in rows.items()])
    shorter = {}
    for d, (text, source) in rows.items():
        left = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone[d])
        if not gone[d] or brute.WORD.search(left):
            shorter[d] = (left, source)
    found = brute.jaccard_components([(d, t) for d, (t, _) in shorter.items()], 5, 80)
    single = {d: v for d, v in shorter.items() if found[d][1] == d}
    targets = brute.mix([(d, s, len(brute.WORD.findall(t))) for d, (t, s) in single.items()])
    want = Counter()
    for source, (size, target) in targets.items():
        whole = int(target // size) if size else 0
        room = target - whole * size
        before = 0
        own = [(hashlib.md5(f"mix-1|{d}".encode()).hexdigest(), d) for d, (_, s) in single.items() if s == source]
        for _, d in sorted(own):
            text = single[d][0]
            words = len(brute.WORD.findall(text))
            extra = max(0, min(words, int(np.floor(room - before + 0.5))))
            before += words
            want[d, text] += whole
            if extra:
                cut = [m.end() for m in brute.WORD.finditer(text)][extra - 1] if extra < words else len(text)
                want[d, text[:cut]] += 1
    got = Counter()
    model = bpe.load(corpus_pipeline_vocabulary())
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        text = model.decode(r.ids)
        assert len(r.ids) == r.n_tokens and hashlib.sha256(text.encode()).hexdigest() == r.decoded_sha256
        got[r.doc_id, text] += 1
    assert got == +want


def corpus_pipeline_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(corpus_pipeline.VOCABULARY)


def test_stages_keep_columns_and_take_odd_rows(spark, docs_of):
    for rows in ([*ODD_TEXTS, ODD_TEXTS[5], (40, ODD_TEXTS[6][1])], []):
        docs = docs_of(rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == len(rows)


def test_columns_named_like_those_inside_stay(spark, docs_of):
    inside = ["_gone", "_GONE_DOC", "_gone_digest", "_plan", "_plan_source", "_mix", "_copy", "_extra", "_line_runs", "_mix_figures"]
    run = "\n".join(f"line {k} of a run that comes again" for k in range(6))
    rows = [(1, f"first words of one document\n{run}"), (2, f"other words in the next one\n{run}"), (3, "a third text"), (3, "a third text")]
    docs = docs_of(rows)
    for name in inside:
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.col("doc_id").cast("string")))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        plain = stage(spark, docs.drop(*inside), "")
        assert sorted(map(tuple, out.drop(*inside).collect())) == sorted(map(tuple, plain.collect())), name
        for r in out.collect():
            assert all(r[c] == f"{c} of {r.doc_id}" for c in inside)
