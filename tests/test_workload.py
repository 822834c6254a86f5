"""Queries against their check SQL on the smallest tables, where these are present."""

import math
import os

import pytest

DATA = "/root/testdata/sf0.001"
NAMES = ["i1_detect_shift", "i7_early_window", "i13_label_table", "i14_person_period_lead2", "i16_renewed_production",
         "i19_modelling_window", "i24_label_sensitivity", "j15_auc_brier", "j25_bootstrap_counts", "j27_coincidence", "b10_mask_outliers",
         "d17_spearman_pooled", "c10_concordance", "e15_deepest_fall"]


def norm(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return repr(v)
    return "nan" if math.isnan(float(v)) else repr(round(float(v), 6) + 0.0)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import workload

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    got = workload.QUERIES[name](spark, DATA)
    cols = sorted(got.columns)
    res = con.execute(workload.SQL[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in res.fetchall())
    assert sorted(tuple(norm(v) for v in r) for r in got.select(*cols).collect()) == want


def test_every_query_is_named_and_sql_has_a_query():
    import workload

    assert set(workload.SQL) <= set(workload.QUERIES) and len(workload.QUERIES) > 150


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_consumption_bins_keep_levels_of_zero(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    import workload

    con = duckdb.connect()
    for f in os.listdir(DATA):
        os.symlink(f"{DATA}/{f}", tmp_path / f) if not f.startswith("events") else None
    con.execute(f"""copy (select * replace (case when user_id % 3 = 0 and day(ts) >= 20 then 0.0 else value end as value)
        from '{DATA}/events.parquet') to '{tmp_path}/events.parquet' (format parquet)""")
    for f in os.listdir(tmp_path):
        con.execute(f"create view {f.split('.')[0]} as select * from '{tmp_path}/{f}'")
    got = workload.QUERIES["i23_consumption_bins"](spark, str(tmp_path)).select("bin", "median", "n").collect()
    want = con.execute(f"select bin, median, n from ({workload.SQL['i23_consumption_bins']})").fetchall()
    assert None in {r[0] for r in want}
    assert sorted(tuple(map(norm, r)) for r in got) == sorted(tuple(map(norm, r)) for r in want)
