from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from footfall.functions.geo import plus_code_region
from footfall.functions.text import parse_list, sid_text
from footfall.operators import cleaning
from footfall.operators.regions import decode_region


def one(df):
    return [tuple(r) for r in df.collect()]


def test_parse_list(spark):
    texts = [None, "[]", "[1, 2]", "[Timestamp('2012-04-03 18:00:09')]", "junk", "[1, x]", "[1, 'a']"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(parse_list(F.col("t"))).collect()] == [[], [], [1, 2], [], [], [], []]
    words = spark.createDataFrame([("['a', 'b']",), ("[]",)], "t string")
    assert [r[0] for r in words.select(parse_list(F.col("t"), "string")).collect()] == [["a", "b"], []]


def test_numbers(spark):
    texts = ["abc", "", None, "90", "-90", "90.0001", " 1.5 ", "1e2", "1d", "NaN", "12,5"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(cleaning.to_number(F.col("t"))).collect()]
    assert got == [None, None, None, 90.0, -90.0, 90.0001, 1.5, 100.0, None, None, None]


def test_valid_coords_are_inclusive(spark):
    rows = [(90.0, 180.0), (-90.0, -180.0), (90.0001, 0.0), (0.0, 181.0), (None, 0.0), (0.0, None)]
    df = spark.createDataFrame(rows, "lat double, lon double")
    assert one(cleaning.valid_coords(df)) == [(90.0, 180.0), (-90.0, -180.0)]


@pytest.mark.parametrize(
    "lat, lon, code",
    [
        (40.75, -73.99, "87G8Q2"),
        (40.7, -74.0, "87G8P2"),
        (90.0, 180.0, "C2X2X2"),
        (-33.9, 151.2, "4RRH46"),
        (None, 1.0, None),
        (1.0, None, None),
    ],
)
def test_plus_code(spark, lat, lon, code):
    df = spark.createDataFrame([(lat, lon)], "lat double, lon double")
    assert df.select(plus_code_region(F.col("lat"), F.col("lon"))).first()[0] == code


def test_plus_code_borders_match_the_rounding_rule(spark):
    """Cell borders and their neighbours, against the rule spelled out with decimals."""
    from decimal import ROUND_HALF_EVEN, Decimal
    from math import floor, nextafter

    rows = []
    for i in range(-1799, 1800, 7):
        border = i * 0.05
        for lat in (border, nextafter(border, 100), nextafter(border, -100)):
            if -90 <= lat <= 90:
                rows.append((lat, lat * 2))
    df = spark.createDataFrame(rows, "lat double, lon double")
    got = df.select("lat", "lon", plus_code_region(F.col("lat"), F.col("lon")).alias("c")).collect()
    alphabet = "23456789CFGHJMPQRVWX"

    def index(value, origin, units):
        exact = Decimal((value + origin) * units).quantize(Decimal("0.000001"), ROUND_HALF_EVEN)
        return floor(exact) // (units // 20)

    for r in got:
        a, b = min(index(r.lat, 90, 25_000_000), 3599), index(r.lon, 180, 8_192_000) % 7200
        want = "".join(alphabet[x // s % 20] for s in (400, 20, 1) for x in (a, b))
        assert r.c == want, r


def test_decode_inverts_encode(spark):
    df = spark.createDataFrame([("87G8Q2",), ("4RRH46",), ("nonsense",)], "region string")
    rows = decode_region(df).collect()
    assert (rows[0].lat_min, rows[0].lon_min, rows[0].center_lat, rows[0].center_lon) == (40.75, -74.0, 40.775, -73.975)
    assert rows[0].map_url.endswith("query=40.775,-73.975")
    assert rows[2].lat_min is None and rows[2].map_url is None
    back = decode_region(df).where("lat_min is not null").select("region", plus_code_region(F.col("center_lat"), F.col("center_lon")).alias("r"))
    assert all(r.region == r.r for r in back.collect())


def test_times(spark):
    rows = [
        ("Tue Apr 03 18:00:09 +0000 2012", -240),
        ("Tue Apr 03 18:00:09 +0100 2012", 0),
        ("Wed Jan 01 00:30:00 +0000 2014", -60),
        ("bad", 0),
        ("Xyz Apr 03 18:00:09 +0000 2012", 0),
        (None, 0),
        ("Tue Apr 03 18:00:09 +0000 2012", None),
    ]
    df = spark.createDataFrame(rows, "utc_time string, tz_offset int")
    got = one(cleaning.local_time_text(cleaning.parse_utc(df)).select("time_text"))
    assert got == [("2012-04-03 14:00:09",), ("2012-04-03 17:00:09",), ("2013-12-31 23:30:00",)]


def test_recency_counts_rows_without_offset(spark):
    rows = [(datetime(2012, 4, 3), 0), (datetime(2012, 6, 1), None), (datetime(2011, 6, 30), 0)]
    df = spark.createDataFrame(rows, "utc_time timestamp_ntz, tz_offset int")
    got = cleaning.local_time(cleaning.visit_recency(df)).select("recency").collect()
    assert sorted(r[0] for r in got) == [2, 12]


def test_rows_are_not_shuffled_for_few_places(spark):
    df = spark.createDataFrame([(i % 7, i % 90, i) for i in range(3000)], "pid int, uid int, row_id int")
    kept = cleaning.frequency_filter(df, 10, 10)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [pid" in plan and "SortMergeJoin [pid" not in plan
    assert kept.count() == 3000


def test_frequency_filter_is_one_pass(spark):
    # Place a has two visits, one by a user who is then dropped: a stays with one visit.
    rows = [("u1", "a"), ("u1", "b"), ("u1", "b"), ("u2", "a"), ("u2", "c"), (None, "b")]
    df = spark.createDataFrame(rows, "uid string, pid string")
    got = sorted(one(cleaning.frequency_filter(df, 2, 2)))
    assert got == [("u1", "a"), ("u1", "b"), ("u1", "b")]


def test_missing_column_is_an_error(spark):
    df = spark.createDataFrame([(1,)], "uid int")
    with pytest.raises(ValueError, match="catname"):
        cleaning.project_rename(df, ["uid", "catname"])
    with pytest.raises(ValueError):
        cleaning.rename_positional(df, ["a", "b"])


def test_sid_text(spark):
    df = spark.createDataFrame([([],), ([4],), ([4, 17, 25, 0],)], "codes array<int>")
    assert [r[0] for r in df.select(sid_text(F.col("codes"))).collect()] == ["", "<a_4>", "<a_4><b_17><c_25><d_0>"]


def test_row_order_from_time_and_content(spark):
    late, early, bad = "Tue Apr 03 18:00:09 +0000 2012", "Tue Apr 03 08:00:09 +0000 2012", "bad"
    rows = [("u1", late), ("u1", early), ("u2", early), ("u1", late), ("u1", late), (None, bad)]
    df = spark.createDataFrame(rows, "uid string, utc_time string")
    out = cleaning.with_row_order(df).collect()
    assert sorted((str(r.uid), r.utc_time) for r in out) == sorted((str(u), t) for u, t in rows)
    assert len({r.row_id for r in out}) == len(rows)
    ordered = sorted(out, key=lambda r: r.row_id)
    assert [r.utc_time for r in ordered] == [bad, early, early, late, late, late]
    assert [r.row_block for r in ordered] == sorted(r.row_block for r in out)
    again = cleaning.with_row_order(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_fractional_offsets_are_none_and_names_come_in_any_case(spark):
    rows = [("1", "2", "330.5"), ("1", "2", "330.0"), ("1", "2", "-60"), ("1", "2", "1e2")]
    df = spark.createDataFrame(rows, "lat string, lon string, tz_offset string")
    assert [r.tz_offset for r in cleaning.coerce_numeric(df).collect()] == [None, 330, -60, 100]
    stamps = ["Tue Apr 03 18:00:09 +0000 2012", "tue apr 03 18:00:09 +0000 2012", "TUE APR 03 18:00:09 +0000 2012", "Foo Apr 03 18:00:09 +0000 2012"]
    df = spark.createDataFrame([(s,) for s in stamps], "utc_time string")
    got = [r[0] for r in df.select(cleaning.utc_from_text(F.col("utc_time"))).collect()]
    assert got[0] is not None and got == [got[0]] * 3 + [None]
