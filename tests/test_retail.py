"""Retail operators: exports in three dialects, first copies, intervals, reconciliation, checks, checksums."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnmill.operators import retail as R
from tarnmill.plans.pipelines import identical_rebuilds, retail_build
from tarnmill.sources import readers, writers


@pytest.fixture
def exports(tmp_path):
    d = tmp_path / "exports"
    d.mkdir()
    (d / "SALES_S01_20240531.csv").write_text("bill_no,line_no,product_code,qty,unit_price,line_type,ts\nS01/1,1,P1,2,10.00,sale,2024-06-01T00:10:00\nS01/1,2,P1,1,-1.50,DISCOUNT,2024-05-31T10:00:00\n\nS01/1,3,,1,3.00,TAX,2024-05-31T10:00:00\n")
    (d / "SALES_S01_20240531__R1.csv").write_text("bill_no,line_no,product_code,qty,unit_price,line_type,ts\nS01/1,1,P1,9,99.00,SALE,2024-05-31T10:00:00\n")
    (d / "SALES_S06_20240601.csv").write_text("bill_no;line_no;item_code;quantity;rate;type;txn_time\nS06/1;1;P1;1;20.00;SALE;01-06-2024 12:00:00\nS06/1;2;NOPE;1;5.00;RETURN;01-06-2024 12:00:00\n")
    (d / "SALES_S10_20240602.csv").write_bytes("﻿ts,bill_no,line_no,line_type,product_code,unit_price,qty\n1717286400,S10/1,1,TENDER,,7.00,1\n1717286400,S10/1,2,VOID,P1,7.25,-1\n".encode())
    return str(d)


@pytest.fixture
def masters(spark):
    products = spark.createDataFrame([(1, "P1", "C", dt.date(2020, 1, 1), dt.date(2024, 5, 31)), (2, "P1", "C", dt.date(2024, 6, 1), dt.date(9999, 12, 31))], "product_key long, product_code string, category_id string, valid_from date, valid_to date")
    prices = spark.createDataFrame([(1, Decimal("11.00"), dt.date(2020, 1, 1), dt.date(9999, 12, 31)), (2, Decimal("12.00"), dt.date(2024, 6, 1), dt.date(2024, 6, 1))], "product_sk long, selling_price decimal(12,2), effective_from date, effective_to date")
    return products, prices


def test_dialects(spark, exports):
    got = {(r["bill_no"], r["line_no"], r["source_file"]): r for r in readers.read_sales(spark, exports).collect()}
    assert len(got) == 8
    first = got["S01/1", 1, "SALES_S01_20240531.csv"]
    assert first["line_type"] == "SALE" and first["sale_date"] == dt.date(2024, 5, 31) and first["ts"] == dt.datetime(2024, 6, 1, 0, 10) and first["store_id"] == "S01"
    assert got["S06/1", 1, "SALES_S06_20240601.csv"]["ts"] == dt.datetime(2024, 6, 1, 12) and got["S06/1", 2, "SALES_S06_20240601.csv"]["product_code"] == "NOPE"
    assert got["S10/1", 2, "SALES_S10_20240602.csv"]["ts"] == dt.datetime(2024, 6, 2) and got["S10/1", 2, "SALES_S10_20240602.csv"]["qty"] == Decimal("-1.00")
    with pytest.raises(FileNotFoundError):
        readers.read_sales(spark, exports + "/..")


def test_each_export_is_read_by_its_own_header(spark, tmp_path):
    (tmp_path / "SALES_S01_20240101.csv").write_text('bill_no,line_no,product_code,qty,unit_price,line_type,ts\nA,1,"P,1",2,10.00,SALE,2024-01-01T00:00:00\n')
    (tmp_path / "SALES_S02_20240101.csv").write_text("note,Unit_Price,QTY,ts,line_type,product_code,line_no,bill_no\nx,7.00,3,2024-01-01 08:00:00,SALE,P2,1,B\n\n")
    (tmp_path / "SALES_S13_20240101.csv").write_text("bill_no,line_no,item_code,rate,quantity,type,txn_time\nC,1,P3,5.00,4,SALE,1704067200\n")
    got = {r["bill_no"]: (r["store_id"], r["product_code"], str(r["qty"]), str(r["unit_price"]), r["ts"] is not None) for r in readers.read_sales(spark, str(tmp_path)).collect()}
    assert got == {"A": ("S01", "P,1", "2.00", "10.00", True), "B": ("S02", "P2", "3.00", "7.00", True), "C": ("S13", "P3", "4.00", "5.00", True)}
    (tmp_path / "SALES_S14_20240101.csv").write_text("bill_no,line_no\nC,1\n")
    with pytest.raises(ValueError, match="S14.*lacks"):
        readers.read_sales(spark, str(tmp_path))
    (tmp_path / "notes.csv").write_text("a\n")
    with pytest.raises(ValueError, match="notes"):
        readers.read_sales(spark, str(tmp_path))


def test_each_line_is_parsed_once(spark, exports):
    """Cells are parsed below what is asked of them; asked with them, each line was parsed anew for every cell and filter. No line is shuffled or sorted."""
    plan = writers.plan_text(readers.read_sales(spark, exports), "simple")
    assert plan.count("from_csv") == 2 and "SortMergeJoin" not in plan and "SortAggregate" not in plan


def test_fact(spark, exports, masters):
    fact = retail_build(spark, exports, *masters)
    got = {(r["bill_no"], r["line_no"]): r for r in fact.collect()}
    assert set(got) == {("S01/1", 1), ("S01/1", 2), ("S06/1", 1), ("S06/1", 2), ("S10/1", 2)}  # no tax, no tender
    assert got["S01/1", 1]["revenue"] == Decimal("20.00") and got["S01/1", 1]["product_key"] == 1  # the first file's copy; the day before the switch
    assert got["S06/1", 1]["product_key"] == 2 and got["S06/1", 1]["historical_price"] == Decimal("12.00")
    assert got["S06/1", 2]["product_key"] is None and got["S10/1", 2]["historical_price"] is None
    assert got["S10/1", 2]["revenue"] == Decimal("-7.25")
    monthly = {(r["year"], r["month"]): r["monthly_net_revenue"] for r in R.revenue_by_month(fact).collect()}
    assert monthly == {(2024, 5): Decimal("18.50"), (2024, 6): Decimal("17.75")}
    assert identical_rebuilds(lambda: retail_build(spark, exports, *masters), ["sales_key", "revenue", "historical_price"])


def test_keep_first_is_total(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 2, "a"), (1, 3, "0"), (2, None, "x")], "k int, o int, v string")
    assert sorted(map(tuple, R.keep_first(df, ["k"], ["o"]).collect())) == [(1, 2, "a"), (2, None, "x")]
    assert R.keep_first(df.where("false"), ["k"], ["o"]).count() == 0


def test_interval_join_stays_an_equi_join(spark, masters):
    facts = spark.createDataFrame([("P1", dt.date(2024, 5, 31)), ("P1", dt.date(2024, 6, 1)), ("Q", dt.date(2024, 6, 1))], "code string, d date")
    joined = R.interval_join(facts, masters[0], [("code", "product_code")], "d", "valid_from", "valid_to")
    assert sorted((r["code"], str(r["d"]), r["product_key"]) for r in joined.collect()) == [("P1", "2024-05-31", 1), ("P1", "2024-06-01", 2), ("Q", "2024-06-01", None)]
    assert "NestedLoop" not in writers.plan_text(joined) and "Cartesian" not in writers.plan_text(joined)


def test_reconciliation(spark, tmp_path):
    path = tmp_path / "finance.csv"
    path.write_text("month,revenue_inr,note\n2024-01,100.00,x\n2024-02,100.00,x\n2024-03,5.00,x\n2024-04,0.00,x\n2024-05,7.00,x\n")
    pipeline = spark.createDataFrame([("2024-01", Decimal("100.00")), ("2024-02", Decimal("100.01")), ("2024-03", Decimal("4.00")), ("2024-04", Decimal("1.00"))], "month string, revenue decimal(18,2)")
    got = {r["month"]: r for r in R.reconcile(readers.read_finance(spark, str(path)), pipeline).collect()}
    assert got["2024-01"]["status"] == "MATCH" and got["2024-01"]["root_cause"] == R.EXACT[0]
    assert got["2024-02"]["status"] == "VARIANCE" and got["2024-02"]["difference"] == Decimal("0.01") and got["2024-02"]["difference_percentage"] == Decimal("0.0100")
    assert got["2024-03"]["root_cause"].startswith("Scope difference") and got["2024-04"]["difference_percentage"] == 0
    assert got["2024-05"]["pipeline_revenue"] == 0 and got["2024-05"]["action"] == R.UNKNOWN[1]


def test_checks_and_checksums(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (3, None)], "k int, v string")
    dim = spark.createDataFrame([(1,)], "k int")
    assert R.orphans(df, dim, "k", "k", "o").first()["violations"] == 1 and R.duplicate_keys(df, ["k"], "d").first()["violations"] == 1
    assert R.violations(df, F.col("v").isNull(), "n").first()["violations"] == 1 and R.violations(df.where("false"), F.col("v").isNull(), "n").first()["violations"] == 0
    assert R.additive_checksum(df, ["k", "v"]).first() == R.additive_checksum(df.orderBy(F.desc("v")), ["k", "v"]).first()
    assert R.additive_checksum(df, ["k", "v"]).first() != R.additive_checksum(df.withColumn("k", F.col("k") + 1), ["k", "v"]).first()
    runs = spark.createDataFrame([(3, "x")] * 3, "n_rows long, checksum string")
    assert R.same_every_time(runs).first()["identical"] and not R.same_every_time(runs.unionByName(spark.createDataFrame([(3, "y")], runs.schema))).first()["identical"]
    R.expect(df, F.count(F.lit(1)), 3)
    with pytest.raises(AssertionError):
        R.expect(df, F.count(F.lit(1)), 4)


def test_landing_is_idempotent_and_pruned(spark, tmp_path):
    rows = spark.createDataFrame([("b1", 1, "S1", dt.date(2024, m, 3)) for m in range(1, 6)], "bill string, line int, store_id string, sale_date date")
    path = str(tmp_path / "raw")
    for _ in range(2):
        writers.land_partitioned(rows, path)
    writers.land_partitioned(rows.where("month(sale_date) = 2"), path)
    back = spark.read.parquet(path)
    assert back.count() == 5
    assert "PartitionFilters: [isnotnull(month" in writers.plan_text(back.where("month = 3"))
    flat = str(tmp_path / "flat")
    writers.land_flat(rows, flat)
    assert readers.list_objects(spark, flat, "part-").first()["n_objects"] >= 1


def test_upsert_versions_and_state(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, writers.upserted(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    root = str(tmp_path / "state")
    assert readers.read_state(spark, writers.latest_version(spark, root), "k int, v string").count() == 0
    writers.write_version(old, root)
    state = readers.read_state(spark, writers.latest_version(spark, root), "k int, v string")
    writers.write_version(writers.upserted(state, new, ["k"]), root)
    assert readers.read_state(spark, writers.latest_version(spark, root), "k int, v string").count() == 3
    # a killed write: a newer version without _SUCCESS is not the state, and its number is not given out again
    kept = writers.latest_version(spark, root)
    (tmp_path / "state" / "v000003-dead").mkdir()
    assert writers.latest_version(spark, root) == kept
    assert "/v000004-" in writers.write_version(state, root)
    late = spark.createDataFrame([(2, "z", 1), (2, "a", 9), (2, "m", 5)], "k int, v string, at int")
    assert sorted(map(tuple, writers.upserted(old, late, ["k"], ["at"]).collect())) == [(1, "a"), (2, "a")]
    assert writers.reopened_counts(spark, kept, 3) == {"expected": 3, "found": 3, "same": True}
    assert writers.summary_json(old.agg(F.count(F.lit(1)).alias("n"))) == '{\n  "n": 2\n}'


def test_reports_and_constraints(spark):
    df = spark.createDataFrame([(1, "a|b"), (1, None), (3, "c")], "k int, v string")
    assert writers.as_markdown(df.where("k = 1 and v is not null")) == "| k | v |\n| --- | --- |\n| 1 | a\\|b |"
    got = {r["constraint"]: r["violations"] for r in writers.constraints_met(df, ["k", "v"], ["k"], {"k": (spark.createDataFrame([(1,)], "id int"), "id")}).collect()}
    assert got == {"not null k": 0, "not null v": 1, "unique k": 1, "references k": 1}


def test_date_dimension(spark):
    rows = {str(r["calendar_date"]): r for r in R.date_dimension(spark, "2024-01-01", 366).collect()}
    assert len(rows) == 366 and rows["2024-12-30"]["week"] == 1 and rows["2024-03-03"]["is_weekend"] and rows["2024-03-03"]["day_of_week"] == 0
    assert rows["2024-02-29"]["date_key"] == 20240229 and rows["2024-02-29"]["month_name"] == "February" and rows["2024-02-29"]["day_of_week_name"] == "Thursday"
