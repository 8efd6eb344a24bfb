"""Readers and writers. Paths are anything Spark can open."""

from __future__ import annotations

import os
import tempfile
import urllib.parse
import zipfile

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_any(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Choose the reader by the path: jdbc:..., *.csv, *.json, *.jsonl, *.orc, else Parquet. A CSV text may hold quoted line ends."""
    if path.startswith("jdbc:"):
        return spark.read.format("jdbc").options(url=path, **options).load()
    r = spark.read.options(**options)
    if schema is not None:
        r = r.schema(schema)
    kind = path.rstrip("/*").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return r.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if kind in ("json", "jsonl"):
        return r.json(path)
    return r.orc(path) if kind == "orc" else r.parquet(path)


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 1, fetch: int = 10_000, **options) -> DataFrame:
    """A table or sub-query, in ranges of a numeric column if one is given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize=fetch, **options)
    if column and bounds:
        r = r.options(partitionColumn=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return r.load()


_DERBY_TYPES = {"bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "double": "DOUBLE", "float": "REAL"}


def derby_file(df: DataFrame, table: str, folder: str) -> str:
    """Numbers as a table of a Derby database in one file, and the URL by which any JVM that sees the folder reads it.

    Tasks write CSV files to the folder; the database engine, in the driver's JVM, loads one after another from there. A
    database in a file is read-only, so the executors can open it side by side.
    """
    spark = df.sparkSession
    local = lambda f: urllib.parse.unquote(urllib.parse.urlparse(f).path)
    df.write.csv(f"{folder}/rows", nullValue="")
    files = spark.read.format("binaryFile").load(f"{folder}/rows").filter("length > 0").select("path").collect()  # names only
    manager, home = spark._jvm.java.sql.DriverManager, tempfile.mkdtemp(prefix="derby-")
    spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    url = f"jdbc:derby:{home}/db"
    held = manager.getConnection(f"{url};create=true")
    try:
        held.createStatement().execute(f"CREATE TABLE {table} ({', '.join(f'{n} {_DERBY_TYPES[k]}' for n, k in df.dtypes)})")
        for f in sorted(local(r.path) for r in files):
            held.createStatement().execute(f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, '{table}', '{f}', NULL, NULL, 'UTF-8', 0)")
    finally:
        held.close()
        try:
            manager.getConnection(f"{url};shutdown=true")
        except Py4JJavaError:  # how Derby reports that it has shut down
            pass
    packed = f"{local(folder)}/{table.lower()}.jar"
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_STORED) as z:  # stored, so that pages are found without unpacking
        for at, _, names in os.walk(f"{home}/db"):
            for n in names:
                if not n.endswith(".lck"):
                    z.write(f"{at}/{n}", os.path.relpath(f"{at}/{n}", home))
    return f"jdbc:derby:jar:({packed})db"


def rename(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Lower-case, trimmed headers; an alias becomes its canonical name unless that is there."""
    df = df.toDF(*(c.strip().lower() for c in df.columns))
    for name, others in aliases.items():
        found = next((a for a in others if a in df.columns), None)
        if name not in df.columns and found:
            df = df.withColumnRenamed(found, name)
    return df


def with_audit(df: DataFrame, batch: str | None = None) -> DataFrame:
    """df with when and from where each row came. Needs a file source; give `batch` to have the same rows on a rerun."""
    at = F.lit(batch).cast("timestamp") if batch else F.current_timestamp()
    return df.select("*", at.alias("ingested_at"), F.to_date(at).alias("ingested_on"), F.col("_metadata.file_path").alias("source_file"))


def write(df: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "overwrite") -> None:
    """One job writes all parts; by: one folder per value."""
    w = df.write.mode(mode).format(kind)
    if kind == "csv":
        w = w.option("header", True)
    (w.partitionBy(*by) if by else w).save(path)


def compact(df: DataFrame, path: str, cluster: list[str], parts: int) -> None:
    """Rewrite into so many files, clustered by range and sorted within."""
    df.repartitionByRange(parts, *cluster).sortWithinPartitions(*cluster).write.mode("overwrite").parquet(path)


def append_evolving(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Append to a Parquet table, with new columns if df has some. A column of another type than it has there is an error, and nothing is written."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        held = {f.name: f.dataType for f in read_evolving(spark, path).schema.fields}
        clash = [f"{f.name}: {held[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in df.schema.fields if f.name in held and f.name not in (by or []) and held[f.name] != f.dataType]
        if clash:
            raise ValueError("columns of another type: " + "; ".join(clash))
    write(df, path, by=by, mode="append")


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    """All columns that any part has; null in the rows of parts without them."""
    return spark.read.option("mergeSchema", True).parquet(path)
