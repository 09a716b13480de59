from __future__ import annotations

import math

import numpy as np
import pytest

from footfall.operators import regions, runs, sid_report


def test_collisions(spark):
    rows = [("d", "m", 1, [1, 2]), ("d", "m", 2, [1, 2]), ("d", "m", 2, [1, 2]), ("d", "m", 3, [0, 0]), ("d", "m", 3, [0, 0])]
    df = spark.createDataFrame(rows, "dataset string, model string, pid int, codes array<int>")
    assert tuple(sid_report.sid_collisions(df).first()) == ("d", "m", 2, 1, 5)


@pytest.fixture(scope="module")
def book(spark):
    rows = []
    for pid in range(60):
        rows.append((pid, [pid % 3, pid % 2], "cat" + str(pid % 4), pid % 7, [float(pid), float(-2 * pid), float(pid % 5)]))
    rows.append((99, [1], "cat0", 0, [0.0, 0.0, 1.0]))
    return spark.createDataFrame(rows, "pid int, codes array<int>, catname string, region_id int, vector array<double>")


def test_prefix_counts_cover_all_rows(book):
    first = sid_report.with_prefix(book, sid_report.level_prefix(1))
    assert sum(r.n for r in sid_report.prefix_counts(first).collect()) == book.count()
    combos = sid_report.with_prefix(book, sid_report.combo_prefix())
    assert sum(r.n for r in sid_report.prefix_counts(combos).collect()) == book.count() - 1
    top = sid_report.prefix_frequency(first, 2).collect()
    assert [(r.prefix, r.n) for r in top] == [("1", 21), ("0", 20)]


def test_numeric_tie_order(spark):
    df = spark.createDataFrame([(1, [10]), (2, [9])], "pid int, codes array<int>")
    top = sid_report.prefix_frequency(sid_report.with_prefix(df, sid_report.level_prefix(1)), 1).collect()
    assert top[0].prefix == "9"


def test_draw_is_repeatable_and_bounded(book):
    prefixed = sid_report.with_prefix(book, sid_report.combo_prefix())
    one = sid_report.sample_frequent_prefixes(prefixed, 10, k=4).collect()
    two = sid_report.sample_frequent_prefixes(prefixed.repartition(6), 10, k=4).collect()
    assert sorted(one) == sorted(two) and len(one) == 4 and {r.slot for r in one} == {1, 2, 3, 4}
    assert sid_report.sample_frequent_prefixes(prefixed, 11, k=4).count() == 0


def test_projection_matches_svd(book):
    prefixed = sid_report.with_prefix(book, sid_report.level_prefix(1))
    out = sid_report.project_2d(prefixed).collect()
    x = np.array([r.vector for r in out])
    _, _, v = np.linalg.svd(x - x.mean(0), full_matrices=False)
    want = np.abs(x @ v[:2].T)
    assert np.allclose(np.abs([[r.x, r.y] for r in out]), want)


def test_distances(spark):
    top = spark.createDataFrame([("1,2", 1, 5, 1), ("1,2", 2, 4, 2), ("1,2", 3, 4, 3), ("7,7", 1, 3, 1)], "prefix string, item int, n int, rank int")
    centers = spark.createDataFrame([(1, 40.0, -74.0), (2, 40.1, -74.0), (3, 40.0, -73.0)], "region int, center_lat double, center_lon double")
    pairs = regions.region_pair_distance(regions.combo_region_lists(top, centers))
    stats = regions.combo_distance_stats(pairs).collect()
    assert len(stats) == 1  # one region alone has no pair
    km = {
        (1, 2): 11.1,
        (1, 3): 111 * math.cos(math.radians(40.0)),
        (2, 3): math.hypot(11.1, 111 * math.cos(math.radians(40.05))),
    }
    assert {(r.region_1, r.region_2): r.km for r in pairs.collect()} == pytest.approx(km)
    s = stats[0]
    assert s.mean_km == pytest.approx(np.mean(list(km.values()))) and s.std_km == pytest.approx(np.std(list(km.values())))
    far = max(km, key=km.get)
    assert tuple(s.nearest) == (1, 2) and tuple(s.farthest) == far
    ranks = regions.rank_combos_by_compactness(regions.combo_distance_stats(pairs))
    owner = regions.first_combo_of_region(top, ranks).collect()
    assert {r.region: r.combo for r in owner} == {1: "1,2", 2: "1,2", 3: "1,2"}


@pytest.mark.parametrize(
    "run, want",
    [
        ("org/rqvae-tky-div0.0-commit0.25-lr5e-5", ("TKY", 0.0, 0.25, 5e-5, 1.0, 1.0, False)),
        ("org/rqvae-nyc-div0.75-commit0.5-lr5e-5", ("NYC", 0.75, 0.5, 5e-5, 1.0, 1.0, False)),
        ("rqvae-nyc-div0.25-commit0.5-lr5e-5-without_L_quant", ("NYC", 0.25, 0.5, 5e-5, 0.0, 1.0, False)),
        ("org/Nrqvae-NYC_Exploration-div0.25-commit0.25-lr1e-3", ("NYC_Exploration", 0.25, 0.25, 1e-3, 1.0, 1.0, False)),
        ("Nrqvae-TKY_Exploration-div0.5", ("TKY_Exploration", 0.5, 0.25, 5e-5, 1.0, 1.0, False)),
        ("Nrqvae-withKL-NYC-without_L_reconstruction", ("NYC", 0.25, 0.25, 5e-5, 1.0, 0.0, True)),
        ("something-else", (None, 0.25, 0.25, 5e-5, 1.0, 1.0, False)),
    ],
)
def test_run_names(spark, run, want):
    row = runs.parse_run_name(spark.createDataFrame([(run,)], "run_id string")).first()
    got = (row.dataset_name, row.div_weight, row.commitment_weight, row.lr, row.quant_weight, row.recon_weight, row.use_kl_divergence)
    assert got == want and (row.error is not None) == (want[0] is None)
    assert row.run_name == run.split("/")[-1]
