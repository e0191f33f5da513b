"""Every library query against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os
import re

import duckdb
import pytest

from flatlake.plans import queries as library

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return repr(round(float(v), 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_query(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got = library.QUERIES[name](spark, SF)
    cursor = db.execute(library.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    want = sorted("|".join(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall())
    assert sorted("|".join(plain(r[c]) for c in sorted(names)) for r in got.collect()) == want


def test_rows_without_sql(spark):
    """The queries that have no SQL: every row of their tables once, with values that the definitions allow."""
    rows = {name: library.QUERIES[name](spark, SF).collect() for name in set(library.QUERIES) - set(library.SQL)}
    assert set(rows) == {"message_fields", "page_details", "page_phones", "scored_listings", "stratified_folds"}
    ids = lambda table, key: sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
    for name in ("page_details", "page_phones"):
        assert sorted(r["page_id"] for r in rows[name]) == ids("pages", "page_id")
    for r in rows["page_phones"]:
        assert (r["phone"] == "") == (r["stage"] == "") and re.fullmatch(r"(\+7[3-9][0-9]{9})?", r["phone"])
    for r in rows["page_details"]:
        assert (r["lat"] is None or -90 <= r["lat"] <= 90) and (r["price"] is None or r["price"] >= 0)
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    offers = {r["doc_id"] for r in rows["message_fields"]}
    assert all(r["price"] is None or str(r["price"])[:2] in re.sub("[^0-9]", "", docs[r["doc_id"]]) for r in rows["message_fields"])
    assert not offers & {i for i, t in docs.items() if t is None or not re.search("[0-9]{2}|комн|квартир", t)}
    folded = rows["stratified_folds"]
    assert sorted(r["id"] for r in folded) == ids("orders", "o_orderkey")
    for good in {r["good"] for r in folded}:
        sizes = [sum(r["good"] == good and r["fold"] == k for r in folded) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    for r in rows["scored_listings"]:
        assert 0 <= r["prob"] <= 1 and r["good"] in (0, 1) and r["verdict"] in ("good", "expensive", "arguable")
    mean = lambda good: sum(r["prob"] for r in rows["scored_listings"] if r["good"] == good) / max(1, sum(r["good"] == good for r in rows["scored_listings"]))
    assert mean(1) > mean(0)


def test_plans_are_native(spark):
    for name in ("median_per_district", "snapshot_merge", "fingerprint_masters", "exclusive_quantiles", "feature_rows", "page_phones", "costs_read_back", "message_fields"):
        plan = library.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan, name
