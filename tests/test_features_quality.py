import pytest
from pyspark.sql import functions as F

from fallpoint.operators import compare, features, quality
from fallpoint.plans import jobs
from fallpoint.sources import tables

KEY = dict(id_col="id", day_col="day")


@pytest.fixture(scope="module")
def table(spark):
    rows = [("a", 1, 1.0, 2.0, "x"), ("a", 2, 2.0, None, "x"), ("a", 4, 10.0, 2.0, "x"), ("a", 6, 50.0, 3.0, "x"),
            ("b", 6, 1.0, 1.0, "y"), ("c", 1, 1.0, 0.0, None), ("c", 2, 2.0, 0.0, "z")]
    return spark.createDataFrame(rows, "id string, day int, v double, w double, s string")


def feats(df, **kw):
    out = features.early_window_features(df, **KEY, value_cols=["v", "w"], ratios=[("v", "w")], static_cols=["s"], **kw)
    return {r["id"]: r.asDict() for r in out.collect()}


def test_early_window(table):
    got = feats(table)
    assert got["a"]["v_last"] == 10 and got["a"]["v_mean"] == pytest.approx(13 / 3) and got["a"]["v_n"] == 3
    assert got["a"]["v_slope"] == pytest.approx(22 / 7) and got["a"]["v_over_w"] == 5
    assert got["b"]["v_last"] is None and got["b"]["v_n"] == 0 and got["b"]["s"] == "y"
    assert got["c"]["v_over_w"] is None and got["c"]["s"] is None


def test_no_leak(spark, table):
    later = spark.createDataFrame([("a", 5, -99.0, 7.0, "x"), ("a", 7, 99.0, 7.0, "x")], table.schema)
    assert feats(table)["a"] == feats(table.unionByName(later))["a"]


def test_repeated_day_fails_only_inside_window(spark, table):
    late = spark.createDataFrame([("a", 6, 1.0, 1.0, "x")], table.schema)
    feats(table.unionByName(late))
    with pytest.raises(Exception, match="repeated"):
        feats(table.unionByName(spark.createDataFrame([("a", 2, 1.0, 1.0, "x")], table.schema)))


def test_slope_needs_two_points(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, None), ("a", 3, 6.0), ("a", 4, 8.0), ("b", 1, 1.0)],
                               "id string, day int, v double")
    got = {r["id"]: r["s"] for r in df.groupBy("id").agg(features.slope(F.col("v"), F.col("day")).alias("s")).collect()}
    assert got["a"] == pytest.approx(2) and got["b"] is None


def test_schedule(spark):
    rows = [("a", d, t) for d, t in ((1, 37.0), (2, 37.00001), (3, 33.0))] + [("b", 1, 37.0), ("c", 1, None)]
    df = spark.createDataFrame(rows, "id string, day int, t double")
    got = {r["id"]: tuple(r)[1:] for r in features.schedule_summary(df, **KEY, setpoint_col="t").collect()}
    assert got == {"a": (37.0, 1, 3), "b": (37.0, 0, None), "c": (None, None, None)}


def write(tmp_path, text):
    p = tmp_path / "data.csv"
    p.write_text(text, encoding="utf-8")
    return str(p)


def load(spark, tmp_path, text):
    return tables.load_series(spark, write(tmp_path, text))


def test_csv_problems(spark, tmp_path):
    for text, word in (("cultivo,dia,x\nA,1,0.1\n", "lacks the columns"), ("culture,day,lactate\n", "no data"),
                       ("culture,day,lactate\nA,1,0.5\nA,2,tres\n", "row 3 of the file: 'tres'"),
                       ("culture,day,lactate\nA,1,0.5\nA,,0.7\n", "row 3 of the file has no day")):
        with pytest.raises(quality.TableProblem, match=word):
            load(spark, tmp_path, text)


def test_csv_variants_and_natural_order(spark, tmp_path):
    rows = ["﻿Culture ;DAY;lactate"] + [f"A;{d};{v}" for d, v in enumerate(["0,5", "1,5", "3,0", "4,0", "2,0", "1,0", "0,8"], 1)]
    got = jobs.detect_file(spark, write(tmp_path, "\n".join(rows) + "\n"), str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["occurred"]
    assert tables.read_csv(spark, str(tmp_path / "out")).count() == 1
    up = [0.5, 1.5, 3, 4, 4.2, 4.4, 4.5]
    rows = ["culture,day,lactate"] + [f"{c},{d},{v}" for c in ("C10", "C2") for d, v in enumerate(up, 1)]
    got = jobs.detect_file(spark, write(tmp_path, "\n".join(rows) + "\n")).collect()
    assert [r["culture"] for r in got] == ["C2", "C10"]


def test_split_key_and_fingerprint(spark, tmp_path):
    df = tables.with_split_key(spark.createDataFrame([("C12_d7",), ("x",)], "k string"), "k")
    assert [(r["id"], r["day"]) for r in df.collect()] == [("C12", 7), (None, None)]
    import hashlib

    p = write(tmp_path, "abc")
    tables.require_fingerprint(spark, p, hashlib.sha256(b"abc").hexdigest())
    with pytest.raises(tables.FingerprintMismatch):
        tables.require_fingerprint(spark, p, "0" * 64)


def test_row_numbers_follow_reading_order(spark):
    df = spark.range(1000).repartition(7)
    first = [r["id"] for r in df.collect()]
    got = {r["id"]: r["row"] for r in quality.numbered(df).collect()}
    assert sorted(got.values()) == list(range(1, 1001)) and len(first) == 1000


def test_whole_days_round_half_even(spark):
    df = spark.createDataFrame([("a", 0.5, 1.0), ("a", 1.5, 2.0), ("a", 2.5, 4.0), ("a", None, 1.0)], "id string, day double, v double")
    got = quality.whole_days(df.where("day is not null"), **KEY, value_col="v", starts_at_zero=F.lit(True)).orderBy("day").collect()
    assert [(r["day"], r["v"]) for r in got] == [(1, 1.0), (3, 3.0)]


def test_declared_answers(spark):
    det = spark.createDataFrame([("a", True, 5.0), ("b", False, None), ("c", False, None), ("d", True, 9.0)],
                                "k string, occurred boolean, day double")
    dec = spark.createDataFrame([("a", 6.0, 10.0, False), ("b", None, None, True), ("c", 2.0, 3.0, False), ("d", 4.0, 5.0, False)],
                                "k string, day_min double, day_max double, no_event boolean")
    got = {r["k"]: (r["distance"], r["hit"], r["signed_error"]) for r in compare.score_declared(det, dec, keys=["k"]).collect()}
    assert got["a"] == (1.0, True, -3.0) and got["b"] == (0.0, True, None)
    assert got["c"][0] == float("inf") and got["d"] == (4.0, False, 4.5)
    s = compare.declared_summary(compare.score_declared(det, dec, keys=["k"])).first()
    assert s["hits"] == 2 and not s["passes"]
    with pytest.raises(compare.OrphanRows):
        compare.require_match(det, dec.where("k <> 'a'"), ["k"])


def test_exact_interval(spark):
    from fallpoint.functions.tails import exact_interval, normal_two_sided, student_two_sided

    df = spark.createDataFrame([(7, 9), (7, 8), (0, 5), (5, 5)], "k int, n int")
    lo, hi = exact_interval(F.col("k"), F.col("n"))
    got = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert (round(got[0]["lo"], 2), round(got[0]["hi"], 2)) == (0.40, 0.97)
    assert (round(got[1]["lo"], 2), round(got[1]["hi"], 2)) == (0.47, 1.00)
    assert got[2]["lo"] == 0 and round(got[2]["hi"], 4) == 0.5218 and got[3]["hi"] == 1
    p = spark.range(1).select(normal_two_sided(F.lit(1.959964)).alias("n"), student_two_sided(F.lit(2.228139), F.lit(10)).alias("t")).first()
    assert p["n"] == pytest.approx(0.05, abs=1e-6) and p["t"] == pytest.approx(0.05, abs=1e-6)
