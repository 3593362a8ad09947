"""Retail warehouse: deduplication by business key, interval joins, dimensions, facts, revenue, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.functions.columns import day_of_week, md5_long

#: Line types that make revenue.
REVENUE_LINES = ["SALE", "DISCOUNT", "RETURN", "VOID"]
OTHER_LINES = ["TAX", "TENDER"]
MONEY = "decimal(18,2)"


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows with equal keys the first in an order; other columns break its ties, so the choice is one.

    Ranked within the key: one shuffle by key and one sort. Only a key's first row of each map task is shuffled
    (the limit on the rank goes below the exchange), so a key that repeats without end costs a row per task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order, *rest))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def interval_join(facts: DataFrame, dim: DataFrame, on: list[tuple[str, str]], at: str, start: str, end: str, how: str = "left") -> DataFrame:
    """Facts with the version of dim in force at a date (both ends included).

    The key joins; the interval is a residual of that join, so neither side is crossed with the other.
    """
    condition = F.lit(True)
    for a, b in on:
        condition = condition & (facts[a] == dim[b])
    return facts.join(dim, condition & (facts[at] >= dim[start]) & (facts[at] <= dim[end]), how)


def in_force(dim: DataFrame, day: str, start: str, end: str) -> DataFrame:
    d = F.lit(day).cast("date")
    return dim.where((d >= F.col(start)) & (d <= F.col(end)))


def date_dimension(spark: SparkSession, first: str, days: int) -> DataFrame:
    day = F.date_add(F.lit(first).cast("date"), F.col("id").cast("int"))
    d = spark.range(days).select(day.alias("calendar_date"))
    c = F.col("calendar_date")
    return d.select(
        F.date_format(c, "yyyyMMdd").cast("int").alias("date_key"), c, F.year(c).alias("year"), F.month(c).alias("month"), F.date_format(c, "MMMM").alias("month_name"), F.dayofmonth(c).alias("day"),
        day_of_week(c).alias("day_of_week"), F.date_format(c, "EEEE").alias("day_of_week_name"), F.weekofyear(c).alias("week"), day_of_week(c).isin(0, 6).alias("is_weekend"),
    )


def surrogate_key(bill: str = "bill_no", line: str = "line_no") -> Column:
    return F.md5(F.concat_ws("#", F.col(bill).cast("string"), F.col(line).cast("string")))


def revenue(qty: Column, price: Column) -> Column:
    return F.round(qty * price, 2).cast("decimal(12,2)")


def build_fact(lines: DataFrame, products: DataFrame, prices: DataFrame, order: list[str]) -> DataFrame:
    """Sales facts: first copies of lines, then revenue lines alone, then the product and price in force.

    lines: bill_no, line_no, store_id, sale_date, product_code, qty, unit_price, line_type, source_file, ts.
    Duplicates go before the filter on line types: a line's first copy decides what it is.
    """
    return fact_of(keep_first(lines, ["bill_no", "line_no"], order), products, prices)


def fact_of(first: DataFrame, products: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Facts of first copies. Without prices historical_price is left out: who does not read it joins nothing for it."""
    kept = first.where(F.col("line_type").isin(REVENUE_LINES))
    versions = products.select("product_key", F.col("product_code").alias("_code"), "valid_from", "valid_to")
    priced = interval_join(kept, versions, [("product_code", "_code")], "sale_date", "valid_from", "valid_to")
    if prices is not None:
        revisions = prices.select(F.col("product_sk").alias("_sk"), "selling_price", "effective_from", "effective_to")
        priced = interval_join(priced, revisions, [("product_key", "_sk")], "sale_date", "effective_from", "effective_to")
    return priced.select(
        surrogate_key().alias("sales_key"), "bill_no", "line_no", F.col("store_id").alias("store_key"), "product_key", F.date_format("sale_date", "yyyyMMdd").cast("int").alias("date_key"), "sale_date",
        F.col("qty").alias("quantity"), "unit_price", *([F.col("selling_price").alias("historical_price")] if prices is not None else []), revenue(F.col("qty"), F.col("unit_price")).alias("revenue"), "line_type", "source_file", F.col("ts").alias("txn_time"),
    )


def total(x: str | Column) -> Column:
    return F.round(F.sum(x), 2).cast(MONEY)


def revenue_by_month(fact: DataFrame) -> DataFrame:
    """At the grain of finance: no product join, so lines without a product count."""
    by = fact.groupBy(F.year("sale_date").alias("year"), F.month("sale_date").alias("month"))
    return by.agg(F.countDistinct("bill_no").alias("total_bills"), F.count(F.lit(1)).alias("total_sales_lines"), total("revenue").alias("monthly_net_revenue"))


def revenue_by_store_category(fact: DataFrame, stores: DataFrame, products: DataFrame, categories: DataFrame, first: str, before: str) -> DataFrame:
    """By month, store and category between two dates. Lines without a product drop out here."""
    part = fact.where((F.col("sale_date") >= F.lit(first).cast("date")) & (F.col("sale_date") < F.lit(before).cast("date")))
    star = part.join(stores, part["store_key"] == stores["store_id"]).join(products.select("product_key", "category_id"), "product_key").join(categories, "category_id")
    by = star.groupBy(F.year("sale_date").alias("year"), F.month("sale_date").alias("month"), "store_name", "category_name")
    return by.agg(F.countDistinct("bill_no").alias("transaction_count"), F.sum("quantity").cast(MONEY).alias("total_units_sold"), total("revenue").alias("net_revenue"))


def till_against_catalogue(fact: DataFrame) -> DataFrame:
    """Per month: bills, lines, revenue at the till's prices, at the catalogue's, and net."""
    by = fact.groupBy(F.date_format("sale_date", "yyyy-MM").alias("period"))
    till, catalogue = F.col("quantity") * F.col("unit_price"), F.col("quantity") * F.coalesce("historical_price", "unit_price")
    return by.agg(F.countDistinct("bill_no").alias("bills"), F.count(F.lit(1)).alias("lines"), total(till).alias("till_revenue"), total(catalogue).alias("catalog_revenue"), total("revenue").alias("net_revenue"))


def price_changes(products: DataFrame, prices: DataFrame, day1: str, day2: str, top: int = 10) -> DataFrame:
    """The products whose price differs most between two dates."""
    def on(day: str, name: str) -> DataFrame:
        return in_force(prices, day, "effective_from", "effective_to").select("product_sk", F.col("selling_price").alias(name))

    both = on(day1, "price_1").join(on(day2, "price_2"), "product_sk").where("price_1 <> price_2")
    named = both.join(products.select(F.col("product_key").alias("product_sk"), "product_code"), "product_sk")
    return named.select("product_sk", "product_code", "price_1", "price_2", F.abs(F.col("price_2") - F.col("price_1")).alias("change")).orderBy(F.desc("change"), "product_sk").limit(top)


def store_category_revenue(lines: DataFrame, products: DataFrame, categories: DataFrame, stores: DataFrame, store: str | int, day: str) -> DataFrame:
    """Category revenue of one store from exported lines and the masters; the store's one row is crossed with them."""
    kept = lines.where(F.col("line_type").isin(REVENUE_LINES) & (F.col("store_id") == store))
    now = in_force(products, day, "valid_from", "valid_to").join(categories, "category_id").select(F.col("product_code"), "category_name")
    joined = kept.join(now, "product_code").crossJoin(F.broadcast(stores.where(F.col("store_id") == store).select("store_name").limit(1)))
    return joined.groupBy("store_name", "category_name").agg(F.countDistinct("bill_no").alias("bills"), total(F.col("qty") * F.col("unit_price")).alias("revenue"))


#: What is known of a month's variance, as (month, cause, action).
KNOWN_VARIANCES = [
    ("2024-03", "Scope difference: finance includes bulk institutional order invoiced outside till", "Finance confirmed 486,250.00 INR bulk invoice was processed offline outside the retail till system."),
    ("2024-07", "Source data issue: Pune (S07) till server outage on July 9-11 (lost exports)", "Pune store manager phoned in manual ledger sales of 232,131.70 INR for July 9-11. Digital files do not exist."),
    ("2024-12", "Definition difference: finance rounded each individual bill total to the rupee", "Cumulative bill-level rupee rounding difference of -50.48 INR across 15,605 bills (-0.0001% variance). Align rounding policy."),
]
EXACT = ("Exact Match", "No action required. Revenue sign-off verified.")
UNKNOWN = ("Investigate variance", "Review store export integrity.")


def reconcile(finance: DataFrame, pipeline: DataFrame, known: list[tuple[str, str, str]] = KNOWN_VARIANCES) -> DataFrame:
    """Finance's months against the pipeline's (month, revenue). A month that the pipeline lacks counts as 0.00."""
    joined = finance.join(pipeline.select("month", F.col("revenue").alias("_p")), "month", "left")
    p, f = F.coalesce("_p", F.lit(0)).cast(MONEY), F.col("revenue_inr").cast(MONEY)
    match = F.abs(p - f) < F.lit("0.01").cast("decimal(4,2)")
    cause, action = F.when(match, EXACT[0]), F.when(match, EXACT[1])
    for month, why, what in known:
        cause, action = cause.when(F.col("month") == month, why), action.when(F.col("month") == month, what)
    percent = F.when(f == 0, F.lit(0).cast("decimal(18,4)")).otherwise(F.round((p - f).cast("decimal(18,2)") * 100 / f, 4).cast("decimal(18,4)"))
    return joined.select("month", p.alias("pipeline_revenue"), f.alias("finance_revenue"), (p - f).cast(MONEY).alias("difference"), percent.alias("difference_percentage"), F.when(match, "MATCH").otherwise("VARIANCE").alias("status"), cause.otherwise(UNKNOWN[0]).alias("root_cause"), action.otherwise(UNKNOWN[1]).alias("action"))


def rounding_gap(fact: DataFrame) -> DataFrame:
    """Per month: the sum of lines, the sum of bills rounded to whole units, and their difference."""
    month = F.date_format("sale_date", "yyyy-MM").alias("month")
    bills = fact.groupBy(month, "bill_no").agg(F.sum("revenue").alias("bill"))
    out = bills.groupBy("month").agg(total("bill").alias("line_revenue"), F.sum(F.round("bill", 0)).cast(MONEY).alias("rounded_revenue"))
    return out.withColumn("gap", (F.col("rounded_revenue") - F.col("line_revenue")).cast(MONEY))


def ordered_checksum(df: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """n_rows and the md5 of all rows in order: for small tables, as one task reads them all."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    place = F.col(order[0]) if len(order) == 1 else F.concat_ws("\x01", *order)
    rows = df.select(line.alias("_line"), place.alias("_place"))
    return rows.selectExpr("count(1) as n_rows", "md5(listagg(_line, chr(10)) within group (order by _place)) as checksum")


def additive_checksum(df: DataFrame, columns: list[str]) -> DataFrame:
    """n_rows and a checksum that no order changes: the sum of 32 bits of each row's md5. Any number of tasks share it."""
    line = F.concat_ws("|", *[F.col(c).cast("string") for c in columns])
    return df.select(md5_long(line).alias("_m")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.col("_m").cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("checksum"))


def same_every_time(checksums: DataFrame) -> DataFrame:
    """Whether all runs (n_rows, checksum) agree."""
    return checksums.agg((F.countDistinct("n_rows", "checksum") == 1).alias("identical"))


# ---- quality checks: each is a count that should be 0 ---------------------------------------------------


def orphans(fact: DataFrame, dim: DataFrame, key: str, dim_key: str, name: str) -> DataFrame:
    missing = fact.where(F.col(key).isNotNull()).join(dim.select(F.col(dim_key).alias(key)), key, "left_anti")
    return missing.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def violations(df: DataFrame, condition: Column, name: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(condition.cast("long")), F.lit(0)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def duplicate_keys(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    many = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check_name"), "violations")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expect(df: DataFrame, value: Column, expected) -> None:
    """Raise unless an aggregate has the value that is expected."""
    found = df.agg(value).first()[0]
    if found != expected:
        raise AssertionError(f"expected {expected}, found {found}")
