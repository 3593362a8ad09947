"""Retail queries: lineitem rows as sales lines, orders as bills, suppliers as stores, parts as products.

Bills repeat lines with conflicting copies, so the first copy is taken in the order of all other columns.
Products with a key divisible by 5 are reissued on 1998-07-01; every product's price rises by a tenth in 1997.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnmill.functions.columns import md5_long
from tarnmill.operators import retail as R
from tarnmill.runtime import expire, materialise, scratch, spread
from tarnmill.sources.readers import read_csv, read_sales, read_state
from tarnmill.sources.writers import constraints_met, land_flat, land_partitioned, latest_version, rename_parts, reopened_counts, upserted, write_csv, write_version

LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
#: Line types by (return flag, line status).
LINE_TYPES = {"NO": "SALE", "NF": "DISCOUNT", "RF": "RETURN", "RO": "VOID", "AF": "TAX", "AO": "TENDER"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines_of(raw: DataFrame) -> DataFrame:
    kind = F.concat("l_returnflag", "l_linestatus")
    line_type = F.coalesce(*[F.when(kind == k, v) for k, v in LINE_TYPES.items()], F.lit("OTHER"))
    return raw.select(
        F.col("l_orderkey").alias("bill_no"), F.col("l_linenumber").alias("line_no"), F.col("l_suppkey").alias("store_id"), F.col("l_shipdate").cast("date").alias("sale_date"), F.col("l_partkey").alias("product_code"),
        F.col("l_quantity").cast("decimal(12,2)").alias("qty"), F.col("l_extendedprice").cast("decimal(12,2)").alias("unit_price"), line_type.alias("line_type"), F.lit("lineitem").alias("source_file"), F.col("l_shipdate").alias("ts"),
    )


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE_ORDER))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of(raw_lines(spark, sf_dir))


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First copies, chosen among the rows as they are read: what is derived from them is not shuffled."""
    return lines_of(R.keep_first(raw_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"], LINE_ORDER))


def day(text: str):
    return F.lit(text).cast("date")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    again = F.col("p_partkey") % 5 == 0
    versions = F.when(again, F.array(F.struct(F.lit(0).alias("v"), day("1990-01-01").alias("f"), day("1998-06-30").alias("t")), F.struct(F.lit(1).alias("v"), day("1998-07-01").alias("f"), day("9999-12-31").alias("t")))).otherwise(F.array(F.struct(F.lit(0).alias("v"), day("1990-01-01").alias("f"), day("9999-12-31").alias("t"))))
    rows = part.select("*", F.explode(versions).alias("x"))
    return rows.select((F.col("p_partkey") * 2 + F.col("x.v")).alias("product_key"), F.col("p_partkey").alias("product_code"), F.col("p_type").alias("category_id"), F.col("x.f").alias("valid_from"), F.col("x.t").alias("valid_to"), F.col("p_retailprice").cast("decimal(12,2)").alias("list_price"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = products(spark, sf_dir)
    new = F.round(F.col("list_price") * F.lit("1.10").cast("decimal(4,2)"), 2).cast("decimal(12,2)")
    steps = F.array(F.struct(F.col("list_price").alias("s"), day("1990-01-01").alias("f"), day("1996-12-31").alias("t")), F.struct(new.alias("s"), day("1997-01-01").alias("f"), day("9999-12-31").alias("t")))
    return p.select("product_key", F.explode(steps).alias("x")).select(F.col("product_key").alias("product_sk"), F.col("x.s").alias("selling_price"), F.col("x.f").alias("effective_from"), F.col("x.t").alias("effective_to"))


def fact(spark: SparkSession, sf_dir: str, priced: bool = True) -> DataFrame:
    return R.fact_of(first_lines(spark, sf_dir), products(spark, sf_dir), prices(spark, sf_dir) if priced else None)


def light_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts without product and price: what the grain of finance needs."""
    kept = first_lines(spark, sf_dir).where(F.col("line_type").isin(R.REVENUE_LINES))
    return kept.select("bill_no", "line_no", "sale_date", "product_code", F.col("store_id").alias("store_key"), F.col("qty").alias("quantity"), R.revenue(F.col("qty"), F.col("unit_price")).alias("revenue"), "line_type")


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"), F.col("n_name").alias("state"), F.col("r_name").alias("region"))


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_type").alias("category_id"), F.col("p_type").alias("category_name")).distinct()


def dedup_business_key(spark, sf_dir):
    return first_lines(spark, sf_dir).select("bill_no", "line_no", "sale_date", "product_code", "store_id", "qty", "unit_price", "line_type")


def revenue_monthly(spark, sf_dir):
    return R.revenue_by_month(light_fact(spark, sf_dir)).withColumns({"year": F.col("year").cast("long"), "month": F.col("month").cast("long")})


def revenue_store_category(spark, sf_dir):
    out = R.revenue_by_store_category(fact(spark, sf_dir, priced=False), stores(spark, sf_dir), products(spark, sf_dir), categories(spark, sf_dir), "1996-03-01", "1996-06-01")
    return out.withColumns({"year": F.col("year").cast("long"), "month": F.col("month").cast("long")})


def price_asof_fact(spark, sf_dir):
    return fact(spark, sf_dir).select("sales_key", "bill_no", "line_no", "store_key", "product_key", "date_key", "sale_date", "quantity", "unit_price", "historical_price", "revenue", "line_type")


def scd2_fact_join(spark, sf_dir):
    f = fact(spark, sf_dir, priced=False)
    return f.groupBy((F.col("product_key") % 2).alias("version"), F.year("sale_date").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("n_lines"), R.total("revenue").alias("revenue"))


def price_change_topk(spark, sf_dir):
    return R.price_changes(products(spark, sf_dir), prices(spark, sf_dir), "1996-03-15", "1998-11-15").withColumn("change", F.col("change").cast("decimal(12,2)"))


def till_vs_catalog_revenue(spark, sf_dir):
    return R.till_against_catalogue(fact(spark, sf_dir))


def federated_store_revenue(spark, sf_dir):
    return R.store_category_revenue(lines(spark, sf_dir), products(spark, sf_dir), categories(spark, sf_dir), stores(spark, sf_dir), 1, "1998-08-01")


def finance(months: DataFrame) -> DataFrame:
    """Finance's targets: bills rounded to whole units; one month that the pipeline lacks, one zero target."""
    gap = months.select("month", F.col("rounded_revenue").alias("revenue_inr"))
    extra = months.sparkSession.createDataFrame([("2099-01", "100.00"), ("2099-02", "0.00")], "month string, r string").select("month", F.col("r").cast("decimal(18,2)").alias("revenue_inr"))
    return gap.unionByName(extra)


def finance_reconciliation(spark, sf_dir):
    months = materialise(R.rounding_gap(light_fact(spark, sf_dir)))  # a row a month, read by both sides
    pipeline = months.select("month", F.col("line_revenue").alias("revenue"))
    return R.reconcile(finance(months), pipeline, [("1996-03", "Known difference", "None")])


def rounding_policy_gap(spark, sf_dir):
    return R.rounding_gap(light_fact(spark, sf_dir))


def dim_date(spark, sf_dir):
    d = R.date_dimension(spark, "2024-01-01", 366)
    return d.withColumns({c: F.col(c).cast("long") for c in ("year", "month", "day", "day_of_week", "week")})


def dq_orphans(spark, sf_dir):
    f = materialise(light_fact(spark, sf_dir).select("store_key", "product_code", "bill_no"))
    checks = [R.orphans(f, stores(spark, sf_dir), "store_key", "store_id", "orphan_store"), R.orphans(f, table(spark, sf_dir, "part"), "product_code", "p_partkey", "orphan_product"), R.orphans(f, table(spark, sf_dir, "orders"), "bill_no", "o_orderkey", "orphan_bill")]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


def dq_duplicate_keys(spark, sf_dir):
    raw = R.duplicate_keys(lines(spark, sf_dir), ["bill_no", "line_no"], "raw_lines")
    return raw.unionByName(R.duplicate_keys(light_fact(spark, sf_dir), ["bill_no", "line_no"], "fact"))


def dq_line_types(spark, sf_dir):
    f = lines(spark, sf_dir)
    bad = R.violations(f, ~F.col("line_type").isin(R.REVENUE_LINES + R.OTHER_LINES), "invalid_line_type")
    return bad.unionByName(R.violations(f, F.col("line_type").isin(R.OTHER_LINES), "tax_or_tender"))


def dq_null_measures(spark, sf_dir):
    f = light_fact(spark, sf_dir)
    return R.violations(f, F.col("quantity").isNull() | F.col("revenue").isNull() | F.col("sale_date").isNull(), "null_measures")


def row_counts(spark, sf_dir):
    return R.row_counts({t: table(spark, sf_dir, t) for t in ("region", "nation", "supplier", "part", "orders", "lineitem")})


def integration_star_topk(spark, sf_dir):
    f = fact(spark, sf_dir, priced=False)
    s, p = stores(spark, sf_dir), products(spark, sf_dir).select("product_key", "category_id")
    star = f.join(s, f["store_key"] == s["store_id"]).join(p, "product_key")
    by = star.groupBy("region", "state", "store_name", "category_id", F.year("sale_date").cast("long").alias("year"))
    return by.agg(F.count(F.lit(1)).alias("n_lines"), R.total("revenue").alias("revenue")).orderBy(F.desc("revenue"), "store_name", "category_id", "year").limit(20)


def table_checksum(spark, sf_dir):
    monthly = R.rounding_gap(light_fact(spark, sf_dir))
    return R.ordered_checksum(monthly, ["month", "line_revenue", "rounded_revenue"], ["month"])


def fact_checksum(spark, sf_dir):
    f = lines(spark, sf_dir)
    return R.additive_checksum(f, ["bill_no", "line_no", "sale_date", "product_code", "qty", "unit_price", "line_type"])


_landed: dict[tuple[str, str], str] = {}


def landed(spark: SparkSession, sf_dir: str) -> str:
    """Where the lines lie in store= / year= / month= folders; landed once by an application, by store region."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _landed:
        path = scratch(spark)
        s = stores(spark, sf_dir).select("store_id", F.col("region").alias("store_region"))
        rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("sale_date"), "l_suppkey", F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"))
        land_partitioned(rows.join(F.broadcast(s) if s.limit(500_001).count() <= 500_000 else s, F.col("l_suppkey") == s["store_id"]).drop("store_id", "l_suppkey"), path, "sale_date", "store_region", salts=1)
        expire(spark, path)
        _landed[key] = path
    return _landed[key]


def partition_pruned_scan(spark, sf_dir):
    """A month of the landed folders: other folders are not even listed by the scan."""
    month = spark.read.parquet(landed(spark, sf_dir)).where("year = 1996 and month = 3")
    return month.agg(F.count(F.lit(1)).alias("n_lines"), F.sum("amount").cast("decimal(18,2)").alias("amount"))


def flat_scan(spark, sf_dir):
    """The same month from the flat table: the filter reaches the row groups, but every file is opened."""
    raw = table(spark, sf_dir, "lineitem").where((F.col("l_shipdate") >= F.lit("1996-03-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1996-04-01").cast("timestamp_ntz")))
    return raw.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(18,2)").alias("amount"))


_exported: dict[tuple[str, str], str] = {}
EXPORTED = "'S' || lpad(cast(l_suppkey % 13 + 1 as string), 2, '0')"


def exported(spark: SparkSession, sf_dir: str) -> str:
    """A folder with the lines as exports of 13 stores in their dialects, a file for each store and year; written once by an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key in _exported:
        return _exported[key]
    raw = table(spark, sf_dir, "lineitem").select("*", F.expr(EXPORTED).alias("store"), F.year("l_shipdate").alias("year"))
    kind = F.concat("l_returnflag", "l_linestatus")
    line_type = F.coalesce(*[F.when(kind == k, v) for k, v in LINE_TYPES.items()], F.lit("OTHER"))
    bill, line, item = (F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey"))
    qty, price = (F.col(c).cast("decimal(12,2)").cast("string") for c in ("l_quantity", "l_extendedprice"))
    iso, european, epoch = F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format("l_shipdate", "dd-MM-yyyy HH:mm:ss"), F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).cast("string")
    semicolon, seconds = F.col("store").isin("S06", "S07", "S08", "S09"), F.col("store").isin("S10", "S11", "S12")
    text = F.when(semicolon, F.concat_ws(";", bill, line, item, qty, price, F.lower(line_type), european)).when(seconds, F.concat_ws(",", epoch, price, qty, bill, line, line_type, item)).otherwise(F.concat_ws(",", bill, line, F.concat(F.lit('"'), item, F.lit('"')), qty, price, line_type, iso))
    header = F.when(semicolon, "bill_no;line_no;item_code;quantity;rate;type;txn_time").when(seconds, "\ufeffTS,unit_price,QTY,bill_no,line_no,line_type,product_code").otherwise("bill_no,line_no,product_code,qty,unit_price,line_type,ts")
    file = F.format_string("SALES_%s_%d0101", "store", "year").alias("file")
    rows = raw.select(file, F.lit(1).alias("place"), text.alias("value")).unionByName(raw.select("store", "year").distinct().select(file, F.lit(0).alias("place"), header.alias("value")))
    path = scratch(spark)
    rows.repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(f"{path}-parts")
    rename_parts(spark, f"{path}-parts", path)
    expire(spark, path)
    _exported[key] = path
    return path


def sales_exports(spark, sf_dir):
    rows = read_sales(spark, exported(spark, sf_dir))
    return rows.select(F.col("bill_no").cast("long").alias("bill_no"), "line_no", "store_id", "sale_date", F.col("product_code").cast("long").alias("product_code"), "qty", "unit_price", "line_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("sold_at"), "source_file")


def versioned_state(spark, sf_dir):
    """Two versions of a state table, the second upserted from the first with a load that repeats its keys."""
    root, orders = scratch(spark), table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("amount"))
    write_version(orders.where("o_orderkey % 3 = 0"), root)
    state = read_state(spark, latest_version(spark, root), "o_orderkey long, amount decimal(12,2)")
    load = orders.where("o_orderkey % 2 = 0").select("o_orderkey", F.explode(F.array(*[F.struct((F.col("amount") + k).cast("decimal(12,2)").alias("amount"), F.lit(k).alias("at")) for k in (2, 3, 1)])).alias("x")).select("o_orderkey", "x.*")
    write_version(upserted(state, load, ["o_orderkey"], ["at"]), root)
    expire(spark, root)
    return read_state(spark, latest_version(spark, root), "o_orderkey long, amount decimal(12,2)")


def csv_round_trip(spark, sf_dir):
    """A table written as CSV and read back with a schema."""
    path = scratch(spark)
    write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"), "o_orderpriority"), path)
    expire(spark, path)
    return read_csv(spark, path, "o_orderkey long, o_custkey long, o_totalprice decimal(12,2), o_orderpriority string")


def restart_check(spark, sf_dir):
    """Rows of a landed table, counted when written and again by a session that has nothing cached."""
    path = scratch(spark)
    orders = table(spark, sf_dir, "orders")
    land_flat(orders, path)
    expire(spark, path)
    found = reopened_counts(spark, path, orders.count())
    return spark.createDataFrame([(found["expected"], found["found"], found["same"])], "expected long, found long, same boolean")


def schema_constraints(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return constraints_met(orders, ["o_orderkey", "o_custkey"], ["o_orderkey"], {"o_custkey": (table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0"), "c_custkey")})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dedup_business_key, revenue_monthly, revenue_store_category, scd2_fact_join, price_asof_fact, price_change_topk, till_vs_catalog_revenue, federated_store_revenue, finance_reconciliation,
        rounding_policy_gap, dim_date, dq_orphans, dq_duplicate_keys, dq_line_types, dq_null_measures, row_counts, integration_star_topk, table_checksum, fact_checksum, partition_pruned_scan, flat_scan, sales_exports, versioned_state, csv_round_trip, restart_check, schema_constraints,
    )
}

# ---- the same in SQL -----------------------------------------------------------------------------------

_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LINE_TYPES.items())
_REVENUE = ", ".join(f"'{t}'" for t in R.REVENUE_LINES)
_LINES = f"""lines AS (
  SELECT *, l_orderkey AS bill_no, l_linenumber AS line_no, l_suppkey AS store_id, CAST(l_shipdate AS DATE) AS sale_date, l_partkey AS product_code,
    CAST(l_quantity AS DECIMAL(12,2)) AS qty, CAST(l_extendedprice AS DECIMAL(12,2)) AS unit_price, CASE l_returnflag || l_linestatus {_TYPES} ELSE 'OTHER' END AS line_type
  FROM lineitem)"""
_FIRST = f"""{_LINES}, first_copy AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bill_no, line_no ORDER BY {", ".join(LINE_ORDER)}) AS rn FROM lines) WHERE rn = 1)"""
_LIGHT = f"""{_FIRST}, light AS (
  SELECT *, store_id AS store_key, qty AS quantity, CAST(round(qty * unit_price, 2) AS DECIMAL(12,2)) AS revenue FROM first_copy WHERE line_type IN ({_REVENUE}))"""
_MASTERS = """products AS (
  SELECT p_partkey * 2 + v AS product_key, p_partkey AS product_code, p_type AS category_id, CAST(f AS DATE) AS valid_from, CAST(t AS DATE) AS valid_to, CAST(p_retailprice AS DECIMAL(12,2)) AS list_price
  FROM part JOIN (VALUES (0, '1990-01-01', '1998-06-30', 0), (1, '1998-07-01', '9999-12-31', 0), (0, '1990-01-01', '9999-12-31', 1)) x(v, f, t, single)
    ON (p_partkey % 5 = 0 AND single = 0) OR (p_partkey % 5 <> 0 AND single = 1)),
prices AS (
  SELECT product_key AS product_sk, list_price AS selling_price, DATE '1990-01-01' AS effective_from, DATE '1996-12-31' AS effective_to FROM products
  UNION ALL SELECT product_key, CAST(round(list_price * CAST(1.10 AS DECIMAL(4,2)), 2) AS DECIMAL(12,2)), DATE '1997-01-01', DATE '9999-12-31' FROM products)"""
_FACT = f"""{_LIGHT}, {_MASTERS}, fact AS (
  SELECT md5(bill_no || '#' || line_no) AS sales_key, l.bill_no, l.line_no, l.store_key, p.product_key, CAST(strftime(l.sale_date, '%Y%m%d') AS INTEGER) AS date_key, l.sale_date, l.quantity, l.unit_price,
    r.selling_price AS historical_price, l.revenue, l.line_type
  FROM light l LEFT JOIN products p ON l.product_code = p.product_code AND l.sale_date BETWEEN p.valid_from AND p.valid_to
  LEFT JOIN prices r ON p.product_key = r.product_sk AND l.sale_date BETWEEN r.effective_from AND r.effective_to)"""
_STORES = "stores AS (SELECT s_suppkey AS store_id, s_name AS store_name, n_name AS state, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_GAP = f"""{_LIGHT}, gap AS (
  SELECT month, CAST(sum(bill) AS DECIMAL(18,2)) AS line_revenue, CAST(sum(round(bill, 0)) AS DECIMAL(18,2)) AS rounded_revenue
  FROM (SELECT strftime(sale_date, '%Y-%m') AS month, bill_no, sum(revenue) AS bill FROM light GROUP BY 1, 2) GROUP BY 1)"""


def _total(x: str) -> str:
    return f"CAST(round(sum({x}), 2) AS DECIMAL(18,2))"


def _checks(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS check_name, CAST(({sql}) AS BIGINT) AS violations" for name, sql in rows)


ORACLES: dict[str, str] = {
    "dedup_business_key": f"WITH {_FIRST} SELECT bill_no, line_no, sale_date, product_code, store_id, qty, unit_price, line_type FROM first_copy",
    "revenue_monthly": f"WITH {_LIGHT} SELECT year(sale_date) AS year, month(sale_date) AS month, count(DISTINCT bill_no) AS total_bills, count(*) AS total_sales_lines, {_total('revenue')} AS monthly_net_revenue FROM light GROUP BY 1, 2",
    "revenue_store_category": f"""WITH {_FACT}, {_STORES} SELECT year(sale_date) AS year, month(sale_date) AS month, store_name, category_id AS category_name, count(DISTINCT bill_no) AS transaction_count,
        CAST(sum(quantity) AS DECIMAL(18,2)) AS total_units_sold, {_total('revenue')} AS net_revenue
        FROM fact f JOIN stores s ON f.store_key = s.store_id JOIN products p ON f.product_key = p.product_key WHERE sale_date >= DATE '1996-03-01' AND sale_date < DATE '1996-06-01' GROUP BY 1, 2, 3, 4""",
    "scd2_fact_join": f"WITH {_FACT} SELECT product_key % 2 AS version, year(sale_date) AS year, count(*) AS n_lines, {_total('revenue')} AS revenue FROM fact GROUP BY 1, 2",
    "price_asof_fact": f"WITH {_FACT} SELECT * FROM fact",
    "price_change_topk": f"""WITH {_MASTERS} SELECT a.product_sk, p.product_code, a.selling_price AS price_1, b.selling_price AS price_2, CAST(abs(b.selling_price - a.selling_price) AS DECIMAL(12,2)) AS change
        FROM prices a JOIN prices b ON a.product_sk = b.product_sk JOIN products p ON p.product_key = a.product_sk
        WHERE DATE '1996-03-15' BETWEEN a.effective_from AND a.effective_to AND DATE '1998-11-15' BETWEEN b.effective_from AND b.effective_to AND a.selling_price <> b.selling_price ORDER BY change DESC, a.product_sk LIMIT 10""",
    "till_vs_catalog_revenue": f"""WITH {_FACT} SELECT strftime(sale_date, '%Y-%m') AS period, count(DISTINCT bill_no) AS bills, count(*) AS lines, {_total('quantity * unit_price')} AS till_revenue,
        {_total('quantity * coalesce(historical_price, unit_price)')} AS catalog_revenue, {_total('revenue')} AS net_revenue FROM fact GROUP BY 1""",
    "federated_store_revenue": f"""WITH {_LINES}, {_MASTERS}, {_STORES} SELECT store_name, category_id AS category_name, count(DISTINCT bill_no) AS bills, {_total('qty * unit_price')} AS revenue
        FROM lines l JOIN products p ON l.product_code = p.product_code AND DATE '1998-08-01' BETWEEN valid_from AND valid_to JOIN stores s ON s.store_id = 1 WHERE l.store_id = 1 AND line_type IN ({_REVENUE}) GROUP BY 1, 2""",
    "finance_reconciliation": f"""WITH {_GAP}, finance AS (SELECT month, rounded_revenue AS f FROM gap UNION ALL SELECT '2099-01', 100.00 UNION ALL SELECT '2099-02', 0.00),
        pipeline AS (SELECT strftime(sale_date, '%Y-%m') AS month, {_total('revenue')} AS p FROM light GROUP BY 1),
        joined AS (SELECT month, CAST(coalesce(p, 0) AS DECIMAL(18,2)) AS p, CAST(f AS DECIMAL(18,2)) AS f FROM finance LEFT JOIN pipeline USING (month))
        SELECT month, p AS pipeline_revenue, f AS finance_revenue, CAST(p - f AS DECIMAL(18,2)) AS difference, CAST(CASE WHEN f = 0 THEN 0 ELSE round(CAST((p - f) * 100 AS DOUBLE) / f, 4) END AS DECIMAL(18,4)) AS difference_percentage,
          CASE WHEN abs(p - f) < 0.01 THEN 'MATCH' ELSE 'VARIANCE' END AS status,
          CASE WHEN abs(p - f) < 0.01 THEN '{R.EXACT[0]}' WHEN month = '1996-03' THEN 'Known difference' ELSE '{R.UNKNOWN[0]}' END AS root_cause,
          CASE WHEN abs(p - f) < 0.01 THEN '{R.EXACT[1]}' WHEN month = '1996-03' THEN 'None' ELSE '{R.UNKNOWN[1]}' END AS action FROM joined""",
    "rounding_policy_gap": f"WITH {_GAP} SELECT month, line_revenue, rounded_revenue, CAST(rounded_revenue - line_revenue AS DECIMAL(18,2)) AS gap FROM gap",
    "dim_date": """SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS date_key, d AS calendar_date, year(d) AS year, month(d) AS month, strftime(d, '%B') AS month_name, day(d) AS day, dayofweek(d) AS day_of_week, strftime(d, '%A') AS day_of_week_name,
        week(d) AS week, dayofweek(d) IN (0, 6) AS is_weekend FROM (SELECT CAST(DATE '2024-01-01' + INTERVAL (i) DAY AS DATE) AS d FROM range(0, 366) t(i))""",
    "dq_orphans": f"WITH {_LIGHT} " + _checks([("orphan_store", "SELECT count(*) FROM light WHERE store_key NOT IN (SELECT s_suppkey FROM supplier)"), ("orphan_product", "SELECT count(*) FROM light WHERE product_code NOT IN (SELECT p_partkey FROM part)"), ("orphan_bill", "SELECT count(*) FROM light WHERE bill_no NOT IN (SELECT o_orderkey FROM orders)")]),
    "dq_duplicate_keys": f"WITH {_LIGHT} " + _checks([("raw_lines", "SELECT count(*) FROM (SELECT 1 FROM lines GROUP BY bill_no, line_no HAVING count(*) > 1)"), ("fact", "SELECT count(*) FROM (SELECT 1 FROM light GROUP BY bill_no, line_no HAVING count(*) > 1)")]),
    "dq_line_types": f"WITH {_LINES} " + _checks([("invalid_line_type", "SELECT count(*) FROM lines WHERE line_type NOT IN ('SALE', 'DISCOUNT', 'RETURN', 'VOID', 'TAX', 'TENDER')"), ("tax_or_tender", "SELECT count(*) FROM lines WHERE line_type IN ('TAX', 'TENDER')")]),
    "dq_null_measures": f"WITH {_LIGHT} " + _checks([("null_measures", "SELECT count(*) FROM light WHERE quantity IS NULL OR revenue IS NULL OR sale_date IS NULL")]),
    "row_counts": " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in ("region", "nation", "supplier", "part", "orders", "lineitem")),
    "integration_star_topk": f"""WITH {_FACT}, {_STORES} SELECT region, state, store_name, category_id, year(sale_date) AS year, count(*) AS n_lines, {_total('revenue')} AS revenue
        FROM fact f JOIN stores s ON f.store_key = s.store_id JOIN products p ON f.product_key = p.product_key GROUP BY 1, 2, 3, 4, 5 ORDER BY revenue DESC, store_name, category_id, year LIMIT 20""",
    "table_checksum": f"WITH {_GAP} SELECT count(*) AS n_rows, md5(string_agg(concat_ws('|', month, line_revenue, rounded_revenue), chr(10) ORDER BY month)) AS checksum FROM gap",
    "fact_checksum": f"""WITH {_LINES} SELECT count(*) AS n_rows, CAST(sum(CAST(CAST('0x' || substr(md5(concat_ws('|', bill_no, line_no, sale_date, product_code, qty, unit_price, line_type)), 1, 8) AS BIGINT) AS HUGEINT)) AS DECIMAL(38,0)) AS checksum FROM lines""",
    "partition_pruned_scan": "SELECT count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS amount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-04-01'",
    "flat_scan": "SELECT count(*) AS n_lines, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(18,2)) AS amount FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01' AND l_shipdate < TIMESTAMP '1996-04-01'",
    "sales_exports": f"""WITH {_LINES}, coded AS (SELECT *, 'S' || lpad((l_suppkey % 13 + 1)::VARCHAR, 2, '0') AS code, year(l_shipdate) AS y FROM lines)
        SELECT bill_no, line_no::INT AS line_no, code AS store_id, make_date(y, 1, 1) AS sale_date, product_code, qty, unit_price, line_type, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS sold_at, 'SALES_' || code || '_' || y || '0101.csv' AS source_file FROM coded""",
    "versioned_state": "SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(12,2)) + CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 0 END AS DECIMAL(12,2)) AS amount FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0",
    "csv_round_trip": "SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderpriority FROM orders",
    "restart_check": "SELECT count(*) AS expected, count(*) AS found, true AS same FROM orders",
    "schema_constraints": """SELECT 'not null o_orderkey' AS "constraint", count(*) - count(o_orderkey) AS violations FROM orders UNION ALL SELECT 'not null o_custkey', count(*) - count(o_custkey) FROM orders
        UNION ALL SELECT 'unique o_orderkey', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'references o_custkey', count(*) FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)""",
}
