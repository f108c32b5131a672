"""Result tables: one consistent set at a time, read back with an explicit error row when absent.

A set of results is written to a folder of its own. Its line in the manifest comes last, so a set counts once all its
tables are there: a write that fails leaves the set before it, and a reader never sees tables of two sets.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType
from pyspark.sql.utils import AnalysisException

TABLES = ("comparison", "sampling", "findings")
MANIFEST = "version LONG, folder STRING, tables MAP<STRING, LONG>, schemas MAP<STRING, STRING>"


def write_results(path: str, comparison: DataFrame, sampling: DataFrame | None, findings: DataFrame, csv: Mapping[str, DataFrame] | None = None) -> int:
    """Comparison (partitioned by fund size), sampling summary, findings lines and flat tables as one new set; its version."""
    spark = comparison.sparkSession
    version = max((r["version"] for r in published(spark, path).select("version").collect()), default=0) + 1  # a row a set
    folder = f"set-{version:06d}-{uuid.uuid4().hex}"
    comparison.write.partitionBy("aum").parquet(f"{path}/{folder}/comparison")
    if sampling is not None:
        sampling.write.parquet(f"{path}/{folder}/sampling")
    # A handful of sentences, kept in order in one text file.
    findings.orderBy("seq").coalesce(1).select(F.concat(F.lit("- "), "text").alias("value")).write.text(f"{path}/{folder}/findings")
    for name, table in (csv or {}).items():
        write_csv(f"{path}/{folder}/{name}", table)
    schemas = {t: df.schema.json() for t, df in zip(TABLES, (comparison, sampling, findings)) if df is not None}  # an empty table has no file to tell it
    counts = {t: _open(spark, f"{path}/{folder}", t, schema).count() for t, schema in schemas.items()}
    spark.createDataFrame([(version, folder, counts, schemas)], MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def write_csv(path: str, table: DataFrame) -> None:
    """Flat tables as CSV with a header; map columns are left out."""
    flat = [f.name for f in table.schema.fields if f.dataType.typeName() not in ("map", "array", "struct")]
    table.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The manifest: version, folder and rows of each table of every complete set."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    except AnalysisException:
        return spark.createDataFrame([], MANIFEST)


def newest(spark: SparkSession, path: str) -> tuple[str, dict[str, str]] | None:
    """Folder and schemas of the newest complete set; of two written at once, the one whose folder comes last by name."""
    line = published(spark, path).orderBy(F.desc("version"), F.desc("folder")).first()
    return None if line is None else (f"{path}/{line['folder']}", line["schemas"])


def read_results(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The three tables of the newest complete set; findings come without their bullet. Missing ones are one ``error`` row."""
    folder, schemas = newest(spark, path) or (path, {})
    return {t: _open(spark, folder, t, schemas[t]) if t in schemas else _missing(spark, f"{folder}/{t}") for t in TABLES}


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A flat table of the newest complete set."""
    found = newest(spark, path)
    return _missing(spark, f"{path}/{name}") if found is None else spark.read.csv(f"{found[0]}/{name}", header=True, inferSchema=True)


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Delete the tables of all but the ``keep`` newest sets; the manifest goes on listing the others."""
    lines = published(spark, path).orderBy(F.desc("version"), F.desc("folder")).select("folder").collect()
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for line in lines[max(keep, 1):]:
        old = jvm.org.apache.hadoop.fs.Path(f"{path}/{line['folder']}")
        old.getFileSystem(conf).delete(old, True)


def _open(spark: SparkSession, folder: str, table: str, schema: str) -> DataFrame:
    if table == "findings":
        return spark.read.text(f"{folder}/{table}").select(F.regexp_replace("value", "^- ", "").alias("text"))
    return spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{folder}/{table}")


def _missing(spark: SparkSession, path: str) -> DataFrame:
    return spark.range(1).select(F.lit(f"{path} not found, run the full comparison first").alias("error"))
