from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from footfall.operators import quantizer as Q

RNG = np.random.default_rng(5)
DIM = 8
X = RNG.normal(size=(200, DIM))
BOOKS = [RNG.normal(size=(6, DIM)) * s for s in (1.0, 0.6, 0.3)]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "pid int, vector array<double>").repartition(3)


def words(spark, books):
    rows = [(l, c, [float(v) for v in w]) for l, b in enumerate(books) for c, w in enumerate(b)]
    return spark.createDataFrame(rows, "level int, code int, centroid array<double>")


def brute(x, books):
    total, codes, errors, rests = np.zeros_like(x), [], [], []
    for b in books:
        rest = x - total
        rests.append(rest)
        best = np.array([[((r - w) ** 2).sum() for w in b] for r in rest]).argmin(1)
        total = total + b[best]
        codes.append(best)
        errors.append(((x - total) ** 2).sum(1))
    return np.stack(codes, 1), total, np.stack(errors, 1), rests


def test_codes_vector_and_errors(spark, vectors):
    codes, total, errors, _ = brute(X, BOOKS)
    for r in Q.encode_places(vectors, words(spark, BOOKS)).collect():
        assert r.codes == codes[r.pid].tolist()
        assert np.allclose(r.vector, total[r.pid]) and np.allclose(r.level_sq, errors[r.pid])


def test_smallest_index_wins_a_tie(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "pid int, vector array<double>")
    book = words(spark, [[[9.0, 9.0], [1.0, 0.0], [-1.0, 0.0], [1.0, 0.0]]])
    assert {r.pid: r.code for r in Q.nearest_codeword(df, book).collect()} == {1: 1, 2: 1}


def test_many_ties_on_large_numbers(spark):
    base = [[1e6 + k, 1e6] for k in (0.0, 2.0)]
    df = spark.createDataFrame([(1, [1e6 + 1, 1e6]), (2, [1e6 + 1.001, 1e6])], "pid int, vector array<double>")
    assert {r.pid: r.code for r in Q.nearest_codeword(df, words(spark, [base])).collect()} == {1: 0, 2: 1}


def test_codebook_must_be_complete_and_small(spark, monkeypatch):
    with pytest.raises(ValueError, match="codes of level"):
        Q.load_codebooks(words(spark, BOOKS).where("not (level = 1 and code = 2)"))
    monkeypatch.setattr(Q, "MAX_CODEWORDS", 5)
    with pytest.raises(ValueError, match="more than"):
        Q.load_codebooks(words(spark, BOOKS))


def test_ema_step(spark, vectors):
    codes, _, _, rests = brute(X, BOOKS)
    book = words(spark, BOOKS)
    state = book.withColumns({"ema_size": F.lit(2.0), "ema_sum": F.col("centroid")})
    got = {(r.level, r.code): r for r in Q.ema_codebook_update(Q.residuals_per_level(vectors, book), state, DIM).collect()}
    for l, b in enumerate(BOOKS):
        n = np.bincount(codes[:, l], minlength=len(b))
        size = 0.99 * 2.0 + 0.01 * n
        sums = 0.99 * b + 0.01 * np.array([rests[l][codes[:, l] == k].sum(0) for k in range(len(b))])
        norm = (size + 1e-5) / (size.sum() + len(b) * 1e-5) * size.sum()
        for k in range(len(b)):
            assert np.isclose(got[l, k].ema_size, size[k])
            assert np.allclose(got[l, k].ema_sum, sums[k]) and np.allclose(got[l, k].centroid, sums[k] / norm[k])


def test_losses_count_unused_codewords(spark, vectors):
    books = [np.vstack([BOOKS[0], np.full((1, DIM), 1e3)])]
    book = words(spark, books)
    codes, _, errors, _ = brute(X, books)
    encoded = Q.encode_places(vectors, book)
    assigned = Q.explode_codes(encoded)
    n = np.bincount(codes[:, 0], minlength=7)
    assert n[6] == 0
    assert np.isclose(Q.utilization_loss(assigned, book).first().utilization, np.abs(n - 200 / 7).mean())
    kl = (1 / 7 * (np.log(1 / 7) - np.log(n / 200 + 1e-8))).mean()
    assert np.isclose(Q.kl_usage(assigned, book).first().kl_divergence, kl)
    mse = errors[:, 0].mean() / DIM
    loss = Q.quantization_loss(encoded, 0.5, DIM).first()
    assert np.isclose(loss.mse, mse) and np.isclose(loss.loss, mse * 1.5)
    assert np.isclose(Q.reconstruction_mse(encoded, DIM).first().mse, mse)
    pairs = [np.linalg.norm(books[0][i] - books[0][j]) for i in range(7) for j in range(i)]
    assert np.isclose(Q.compactness_loss(book).first().compactness, 2 * np.mean(pairs))


def test_weighted_loss(spark):
    cols = "run string, epoch int, reconstruction double, quantization double, utilization double, compactness double, kl_divergence double"
    df = spark.createDataFrame([("r", e, 1.0, 2.0, 4.0, 8.0, 16.0) for e in (0, 1)], cols)
    plain = Q.weighted_loss(df, Q.loss_weights(div_weight=0.5), 1).orderBy("epoch").collect()
    assert [r.loss for r in plain] == [3.0, 9.0]
    kl = Q.weighted_loss(df, Q.loss_weights(div_weight=0.5, use_kl_divergence=True, quant_weight=0.0), 1).orderBy("epoch").collect()
    assert [r.loss for r in kl] == [1.0, 9.0]


def test_fit_lowers_the_error_per_level(spark, vectors):
    book = Q.fit_codebooks(vectors, vector_num=6, levels=3, max_iter=20)
    assert book.count() == 18
    mse = [r.mse for r in Q.quantization_loss(Q.encode_places(vectors, book), dim=DIM).orderBy("level").collect()]
    assert mse[0] > mse[1] > mse[2] and mse[0] < (X**2).mean()
