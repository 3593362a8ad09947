"""Readers: sales exports in three dialects, notices, labelled pairs, finance targets, masters, state."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnmill.functions.columns import blank_if_null

#: Names under which dialects carry the canonical columns.
ALIASES = {"item_code": "product_code", "quantity": "qty", "rate": "unit_price", "type": "line_type", "txn_time": "ts"}
SALES_COLUMNS = ["bill_no", "line_no", "product_code", "qty", "unit_price", "line_type", "ts"]
#: Stores whose exports are delimited by semicolons (those of all others by commas), and the form of file names.
SEMICOLON_STORES = ["S06", "S07", "S08", "S09"]
EXPORT_NAME = r"^[^_]+_([^_]+)_(\d{8})[^/]*[.]csv$"
MONEY = T.DecimalType(12, 2)


def matching(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Files directly in path whose names match, in the order of their names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path, pattern)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
    return sorted(str(s.getPath()) for s in (found or []))


def sale_timestamp(raw: Column) -> Column:
    """ISO with T or a space, dd-mm-yyyy, or seconds since 1970 (UTC); null if none fits. A shape is tried only on what it may fit: a failed try costs an exception."""
    epoch = F.to_timestamp_ntz(F.timestamp_seconds(F.expr("try_cast(ts as bigint)")))
    may = {"yyyy-MM-dd'T'HH:mm:ss": F.upper(raw).contains("T"), "dd-MM-yyyy HH:mm:ss": F.substring(raw, 3, 1) == "-", "yyyy-MM-dd HH:mm:ss": raw.contains(" ")}
    shapes = [F.when(fits, F.try_to_timestamp(raw, F.lit(shape)).cast("timestamp_ntz")) for shape, fits in may.items()]
    return F.coalesce(*shapes, epoch)


def read_sales(spark: SparkSession, path: str) -> DataFrame:
    """All exports of a folder as one table: the canonical columns, store_id, sale_date (of the file's name), source_file and place.

    Each file is read by its own header, whatever the order and dialect of its columns; names are matched without
    regard to case or a byte-order mark. place orders the rows of a file. Blank lines are skipped. Values stay
    text until cast here; what cannot be cast is null. A file whose name tells no store and day, or whose header
    lacks a column, is an error: no export is passed over in silence.
    """
    files = matching(spark, path, "*.csv")
    if not files:
        raise FileNotFoundError(f"no sales exports in {path}")
    names = [f.rsplit("/", 1)[1] for f in files]
    if strange := [n for n in names if not re.match(EXPORT_NAME, n)]:
        raise ValueError(f"files that no store claims: {strange[:5]}")
    lines = spark.read.option("pathGlobFilter", "*.csv").text(path)
    lines = lines.select(F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), F.when(F.col("value").startswith("\ufeff"), F.expr("substring(value, 2)")).otherwise(F.col("value")).alias("line"))
    lines = lines.where(F.trim("line") != "")

    # a file's header is its first line: one small row a file, with what its name tells; numbers are compared first, as lines would be sorted
    few = len(files) <= 500_000
    small = F.broadcast if few else (lambda df: df)
    first = lines.where("block = 0").groupBy("source_file").agg(F.min("row").alias("header_row"))
    heads = lines.where("block = 0").join(small(first), "source_file").where("row = header_row").select("source_file", "header_row", "line")
    store = F.regexp_extract("source_file", EXPORT_NAME, 1)
    day = F.try_to_timestamp(F.regexp_extract("source_file", EXPORT_NAME, 2), F.lit("yyyyMMdd")).cast("date")
    heads = heads.withColumn("sep", F.when(store.isin(SEMICOLON_STORES), ";").otherwise(","))
    canonical = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    titles = F.transform(F.split("line", F.concat(F.lit("["), F.col("sep"), F.lit("]"))), lambda c: F.lower(F.trim(F.regexp_replace(c, '^\\s*"|"\\s*$', ""))))
    headers = heads.select("source_file", "header_row", "sep", store.alias("store_id"), day.alias("sale_date"), F.transform(titles, lambda c: F.coalesce(F.element_at(canonical, c), c)).alias("titles"))
    lacking = headers.withColumn("lacking", F.array_except(F.array(*[F.lit(c) for c in SALES_COLUMNS]), "titles"))
    said = lacking.agg(F.max(F.size("titles")), F.min(F.when(F.size("lacking") > 0, F.concat_ws(" ", "source_file", F.lit("lacks"), F.array_join("lacking", ","))))).first()
    if said[1]:
        raise ValueError(said[1])

    width = said[0] or 1
    schema = ", ".join(f"c{k} string" for k in range(width))
    cells = F.when(F.col("sep") == ";", F.from_csv("line", F.lit(schema), {"sep": ";"})).otherwise(F.from_csv("line", F.lit(schema), {"sep": ","}))
    rows = lines.join(small(headers), "source_file").where(F.col("row") != F.col("header_row"))
    # exploding keeps what is asked of the cells behind their parsing, else each line is parsed again for every cell and filter
    rows = rows.withColumn("cells", F.explode(F.array(cells)))
    values = F.array(*[F.trim(F.col(f"cells.c{k}")) for k in range(width)])
    rows = rows.withColumn("values", values).select(
        *[F.get("values", (F.array_position("titles", c) - 1).cast("int")).alias(c) for c in SALES_COLUMNS], "store_id", "sale_date", "source_file", F.struct("block", "row").alias("place"),
    )
    return rows.where("bill_no is not null and bill_no <> ''").select(
        "bill_no", F.expr("try_cast(line_no as int)").alias("line_no"), "store_id", "sale_date", "product_code",
        F.expr("try_cast(qty as decimal(12,2))").alias("qty"), F.expr("try_cast(unit_price as decimal(12,2))").alias("unit_price"),
        F.upper("line_type").alias("line_type"), sale_timestamp(F.col("ts")).alias("ts"), "source_file", "place",
    )


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, header: bool = True, infer: bool = False, sep: str = ",") -> DataFrame:
    """CSV with a schema, all text (the default), or inferred types (a second pass over the data)."""
    reader = spark.read.options(header=header, sep=sep, inferSchema=infer)
    return (reader.schema(schema) if schema else reader).csv(path)


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """Notices from Parquet files, else CSV files, of a folder. Null title and body become empty."""
    for kind in ("parquet", "csv"):
        if files := matching(spark, path, f"*.{kind}"):
            raw = read_parquet(spark, *files) if kind == "parquet" else read_csv(spark, files)
            return raw.select(
                "notice_id", "portal_id", F.expr("try_cast(published_at as date)").alias("published_at"), blank_if_null("title").alias("title"), blank_if_null("body").alias("body"),
                F.expr("try_cast(replace(cast(estimated_value as string), ',', '') as double)").alias("estimated_value"), F.expr("try_cast(closing_date as date)").alias("closing_date"),
            )
    raise FileNotFoundError(f"no notices in {path}")


def read_label_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Labelled pairs: trimmed, label in lower case, missing optional columns empty. place orders the rows."""
    raw = read_csv(spark, path)
    optional = [F.trim(blank_if_null(c)).alias(c) if c in raw.columns else F.lit("").alias(c) for c in ("adjudicated_by", "adjudicated_on")]
    return raw.select(F.trim("notice_id_a").alias("notice_id_a"), F.trim("notice_id_b").alias("notice_id_b"), F.lower(F.trim("label")).alias("label"), *optional, F.monotonically_increasing_id().alias("place"))


def read_finance(spark: SparkSession, path: str) -> DataFrame:
    """month (yyyy-MM) and revenue_inr, whatever other columns there are."""
    return read_csv(spark, path).select(F.trim("month").alias("month"), F.col("revenue_inr").cast("decimal(18,2)").alias("revenue_inr"))


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a relational server; filters and columns are pushed to it. Its driver must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def use_object_store(spark: SparkSession, endpoint: str, access_key: str, secret_key: str) -> None:
    """Let s3a:// paths reach an S3-compatible store."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in {"endpoint": endpoint, "access.key": access_key, "secret.key": secret_key, "path.style.access": "true"}.items():
        conf.set(f"fs.s3a.{key}", value)


def list_objects(spark: SparkSession, path: str, contains: str = "") -> DataFrame:
    """n_objects and n_bytes of the files below path whose names hold a string; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.where(F.col("path").contains(contains)).agg(F.count(F.lit(1)).alias("n_objects"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def read_state(spark: SparkSession, path: str | None, schema: str) -> DataFrame:
    """A table written earlier, or an empty one where there is none yet."""
    if path and matching(spark, path, "*.parquet"):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def numbers(spark: SparkSession, start: int, end: int, name: str = "n") -> DataFrame:
    return spark.range(start, end).withColumnRenamed("id", name)


def register(df: DataFrame, name: str) -> None:
    """A frame as a relation for SQL; DROP VIEW or spark.catalog.dropTempView takes it away."""
    df.createOrReplaceTempView(name)


def table_names(spark: SparkSession) -> set[str]:
    return {t.name for t in spark.catalog.listTables()}
