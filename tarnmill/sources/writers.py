"""Writers: landings, replaced tables, upserts, versioned state, text outputs, plans."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarnmill.sources.readers import matching


def land_partitioned(df: DataFrame, path: str, date_col: str = "sale_date", store_col: str = "store_id", salts: int = 4) -> None:
    """store= / year= / month= folders. Landing a month again replaces that month alone, so a rerun changes nothing.

    Rows are dealt by the folders' keys and a few salts before writing: folders get a file a salt at most, large stores
    spread over the salts.
    """
    parts = df.withColumns({"store": F.col(store_col), "year": F.year(date_col), "month": F.month(date_col)})
    dealt = parts.repartition("store", "year", "month", F.pmod(F.xxhash64(*df.columns[:2]), F.lit(salts)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("store", "year", "month").parquet(path)


def rename_parts(spark: SparkSession, written: str, path: str, ending: str = ".csv") -> None:
    """Files of a partitioned landing (key=NAME/part-...) as path/NAME.csv: a name a file, which is to have one part."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = at(written).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(at(path))
    for part in matching(spark, written, "*=*/part-*"):
        name = part.rsplit("/", 2)[1].split("=", 1)[1]
        if not files.rename(at(part), at(path, name + ending)):
            raise FileExistsError(f"{name} has several parts")
    files.delete(at(written), True)


def land_flat(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """CREATE OR REPLACE TABLE ... AS."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """old with new's rows in place of those of equal keys.

    Keys that repeat within new keep their last row by the columns of order (of new, which old need not have);
    without any, or where it ties, the other columns decide, so the choice is one.
    """
    order = order or []
    both = old.withColumns({"_new": F.lit(0), **{f"_o{k}": F.lit(None).cast(new.schema[c].dataType) for k, c in enumerate(order)}})
    both = both.unionByName(new.withColumns({"_new": F.lit(1), **{f"_o{k}": F.col(c) for k, c in enumerate(order)}}).select(*both.columns))
    rest = [F.col(c) for c in old.columns if c not in keys]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new"), *[F.desc(f"_o{k}") for k in range(len(order))], *rest))
    return both.withColumn("_rank", rank).where("_rank = 1").select(*old.columns)


def _finished(spark: SparkSession, root: str) -> list[str]:
    """Versions below root whose writing was completed, oldest first."""
    return [p.rsplit("/", 1)[0] for p in matching(spark, root, "v*/_SUCCESS")]


def write_version(df: DataFrame, root: str) -> str:
    """df as the next version below root: state can be read and replaced in one job, and readers of the last are safe.

    A version counts once its _SUCCESS is there; what a killed write leaves is passed over, and its number too.
    """
    numbers = [int(p.rsplit("/", 1)[1][1:7]) for p in matching(df.sparkSession, root, "v[0-9]*")]
    path = f"{root}/v{max(numbers, default=0) + 1:06d}-{uuid.uuid4().hex[:8]}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(path)
    return path


def latest_version(spark: SparkSession, root: str) -> str | None:
    seen = _finished(spark, root)
    return seen[-1] if seen else None


def reopened_counts(spark: SparkSession, path: str, rows: int) -> dict[str, int | bool]:
    """The restart check: the rows of a written table, counted in a session that has nothing cached, against those expected."""
    again = spark.newSession()
    found = again.read.parquet(path).count()
    return {"expected": rows, "found": found, "same": found == rows}


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def as_json(df: DataFrame, name: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def as_markdown(df: DataFrame, rows: int = 100) -> str:
    """The first rows of a small result as a Markdown table, for reports."""
    found = df.limit(rows).collect()
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in found])


def constraints_met(df: DataFrame, not_null: list[str], unique: list[str], references: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """constraint, violations: what a schema with keys would refuse, counted before a table is replaced."""
    checks = [df.agg(F.coalesce(F.sum(F.col(c).isNull().cast("long")), F.lit(0)).alias("violations")).select(F.lit(f"not null {c}").alias("constraint"), "violations") for c in not_null]
    if unique:
        checks.append(df.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"unique {','.join(unique)}").alias("constraint"), "violations"))
    for c, (other, key) in references.items():
        missing = df.where(F.col(c).isNotNull()).join(other.select(F.col(key).alias(c)), c, "left_anti")
        checks.append(missing.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(f"references {c}").alias("constraint"), "violations"))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def summary_json(df: DataFrame) -> str:
    """A table of one row as indented JSON text."""
    return json.dumps(json.loads(as_json(df).first()[0]), indent=2, sort_keys=True)


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """What EXPLAIN prints."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)
