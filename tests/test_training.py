"""Codebooks fitted and trained, against plain numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.operators import quantizer as Q
from footfall.operators import sid_report, training
from footfall.sources import files

DIM = 5
X = np.random.default_rng(8).normal(size=(300, DIM))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(X)]
    return spark.createDataFrame(rows, "pid int, vector array<double>").repartition(3)


def as_books(codewords):
    out = {}
    for r in codewords.orderBy("level", "code").collect():
        out.setdefault(r.level, []).append(r.centroid)
    return [np.array(out[level]) for level in sorted(out)]


def nearest(x, words):
    return ((x[:, None, :] - words[None]) ** 2).sum(2).argmin(1)


def brute_fit(x, k, levels, steps):
    rest, books = x, []
    for level in range(levels):
        draw = sorted(range(len(x)), key=lambda i: hashlib.md5(f"2024|{level}|{i}".encode()).hexdigest())[:k]
        words = rest[draw]
        for _ in range(steps):
            code = nearest(rest, words)
            units = np.floor(rest * Q.UNITS + 0.5)
            words = np.array([units[code == c].sum(0) / Q.UNITS / (code == c).sum() if (code == c).any() else w for c, w in enumerate(words)])
        books.append(words)
        rest = rest - words[nearest(rest, words)]
    return books


@pytest.mark.parametrize("steps", [0, 1, 4])
def test_fit_against_numpy(spark, vectors, steps):
    got = as_books(Q.fit_codebooks(vectors, vector_num=7, levels=3, max_iter=steps))
    for found, want in zip(got, brute_fit(X, 7, 3, steps), strict=True):
        assert np.allclose(found, want, atol=1e-12, rtol=0)


def test_fit_does_not_depend_on_the_partitions(spark, vectors):
    one = Q.fit_codebooks(vectors.coalesce(1), 6, 2, 3).orderBy("level", "code").collect()
    many = Q.fit_codebooks(vectors.repartition(11), 6, 2, 3).orderBy("level", "code").collect()
    assert one == many


def test_fit_of_few_and_no_rows(spark, vectors):
    few = Q.fit_codebooks(vectors.where("pid < 3"), vector_num=5, levels=2, max_iter=50)
    assert sorted((r.level, r.code) for r in few.collect()) == [(level, code) for level in range(2) for code in range(3)]
    encoded = Q.encode_places(vectors.where("pid < 3"), few)
    assert Q.reconstruction_mse(encoded, DIM).first().mse < 1e-9
    assert Q.fit_codebooks(vectors.where("pid < 0"), vector_num=5, levels=2).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "pid int, vector array<double>")
    assert {tuple(r.centroid) for r in Q.fit_codebooks(same, 3, 1, 5).collect()} == {(1.0, 2.0)}


def brute_epochs(x, books, epochs, weights, start_epoch):
    size = [np.zeros(len(b)) for b in books]
    total = [np.zeros_like(b) for b in books]
    books, log = [b.copy() for b in books], []
    for epoch in range(epochs):
        rest, terms = x, dict.fromkeys(training.TERMS, 0.0)
        for level, words in enumerate(books):
            code = nearest(rest, words)
            n = np.bincount(code, minlength=len(words))
            left = rest - words[code]
            mse = (left**2).mean()
            terms["reconstruction"] = mse
            terms["quantization"] += 1.25 * mse
            terms["utilization"] += np.abs(n - len(x) / len(words)).mean()
            pairs = [np.linalg.norm(a - b) for i, a in enumerate(words) for b in words[i + 1 :]]
            terms["compactness"] += 2 * np.mean(pairs)
            k = len(words)
            terms["kl_divergence"] += (1 / k * (np.log(1 / k) - np.log(n / len(x) + 1e-8))).mean()
            size[level] = 0.99 * size[level] + 0.01 * n
            total[level] = 0.99 * total[level] + 0.01 * np.array([rest[code == c].sum(0) for c in range(k)])
            all_rows = size[level].sum()
            books[level] = total[level] / ((size[level] + 1e-5) / (all_rows + k * 1e-5) * all_rows)[:, None]
            rest = left
        loss = sum(w * terms[t] for t, w in weights.items() if t not in Q.DIVERSITY_TERMS or epoch >= start_epoch)
        log.append((epoch, *(terms[t] for t in training.TERMS), loss))
    return books, log


def test_epochs_against_numpy_and_resumption(spark, vectors, tmp_path):
    words = Q.fit_codebooks(vectors, vector_num=6, levels=2, max_iter=2)
    weights = Q.loss_weights(div_weight=0.5, use_kl_divergence=True)
    books, log = brute_epochs(X, as_books(words), 4, weights, 2)
    start = training.start_state(words)
    straight, resumed = str(tmp_path / "straight"), str(tmp_path / "resumed")
    training.train_codebooks(vectors, start, straight, 4, weights, 2, dim=DIM)
    for epochs in (1, 3, 4, 4):
        training.train_codebooks(vectors, start, resumed, epochs, weights, 2, dim=DIM)
    # What a writer that died has left does not count.
    assert len(files.names_in(spark, resumed)) == 4
    for folder in (straight, resumed):
        got = training.read_log(spark, folder).orderBy("epoch").collect()
        assert np.allclose(np.array(got, float), np.array(log))
        state = training.read_state(spark, folder, 3)
        for found, want in zip(as_books(state), books, strict=True):
            assert np.allclose(found, want)


def test_training_stops_behind_the_best_epoch(spark, vectors, tmp_path, monkeypatch):
    words = Q.fit_codebooks(vectors, vector_num=3, levels=1, max_iter=1)
    worse = iter([3.0, 2.0, 2.0, 5.0, 4.0, 1.0])

    def losses(*args):
        terms = spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, next(worse))], ", ".join(f"{t} double" for t in training.TERMS))
        return terms.withColumn("reconstruction", F.col("kl_divergence"))

    monkeypatch.setattr(training, "epoch_losses", losses)
    best = training.train_codebooks(vectors, training.start_state(words), str(tmp_path / "t"), 9, patience=2, dim=DIM)
    # Epoch 1 is the best, equal later ones are none; epoch 4 is three behind it.
    assert best == 1 and training.read_log(spark, str(tmp_path / "t")).count() == 5


@pytest.mark.parametrize("block", [512, 4])
def test_compactness_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(Q, "PAIR_BLOCK", block)
    words = np.random.default_rng(1).normal(size=(11, 3))
    book = spark.createDataFrame([(0, c, [float(v) for v in w]) for c, w in enumerate(words)], "level int, code int, centroid array<double>")
    want = 2 * np.mean([np.linalg.norm(a - b) for i, a in enumerate(words) for b in words[i + 1 :]])
    assert np.isclose(Q.compactness_loss(book).first().compactness, want)


def test_axes_have_a_fixed_sign(spark):
    x = np.random.default_rng(2).normal(size=(90, 4)) * [3, 2, 1, 0.5]
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "pid int, vector array<double>")
    got = np.array([[r.x, r.y] for r in sid_report.project_2d(rows.repartition(5)).orderBy("pid").collect()])
    _, columns = np.linalg.eigh(np.cov(x.T, bias=True))
    axes = columns.T[::-1][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(1)])[:, None]
    assert np.allclose(got, x @ axes.T)
    flipped = rows.withColumn("vector", F.transform("vector", lambda v: -v))
    back = np.array([[r.x, r.y] for r in sid_report.project_2d(flipped).orderBy("pid").collect()])
    assert np.allclose(back, -got)
    assert sid_report.project_2d(rows.where("pid < 0")).count() == 0
    one = spark.createDataFrame([(1, [2.0]), (2, [4.0])], "pid int, vector array<double>")
    assert sorted((r.x, r.y) for r in sid_report.project_2d(one).collect()) == [(2.0, 0.0), (4.0, 0.0)]
