"""Keyed tables kept as Parquet: upserts, deletes, history, snapshots, resumable loads. Inputs are not changed; results are new tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of source replace those of target with equal keys; others are kept. A key that source repeats is an error when the result is computed."""
    cols = target.columns
    once = source.select(cols).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    once = once.filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"the source repeats a key of {keys}")).cast("boolean")).otherwise(True)).drop("_n")
    return target.join(source.select(*keys), keys, "left_anti").select(cols).unionByName(once)


def delete_keys(target: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(gone.select(*keys).distinct(), keys, "left_anti").select(target.columns)


def beyond(source: DataFrame, target: DataFrame, column: str) -> DataFrame:
    """Rows of source with a higher value than any in target; all of them if target is empty."""
    high = target.agg(F.max(column)).first()[0]
    return source if high is None else source.filter(F.col(column) > F.lit(high))


def row_hash(cols: list[str]) -> Column:
    return F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in cols)), 256)


def history(current: DataFrame, source: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Type-2 history after a snapshot: current has valid_from and valid_to (null: open). Changed and vanished rows are closed at `at`, new versions opened."""
    data = [c for c in current.columns if c not in ("valid_from", "valid_to")]
    now = F.lit(at).cast("timestamp")
    open_ = current.filter("valid_to is null").withColumn("_h", row_hash(data))
    new = source.select(*data).withColumn("_h", row_hash(data))
    closed = open_.join(new.select(*keys, "_h"), [*keys, "_h"], "left_anti").withColumn("valid_to", now)
    same = open_.join(new.select(*keys, "_h"), [*keys, "_h"], "left_semi")
    fresh = new.join(open_.select(*keys, "_h"), [*keys, "_h"], "left_anti").withColumn("valid_from", now).withColumn("valid_to", F.lit(None).cast("timestamp"))
    past = current.filter("valid_to is not null")
    cols = [*data, "valid_from", "valid_to"]
    return past.select(cols).unionByName(closed.select(cols)).unionByName(same.select(cols)).unionByName(fresh.select(cols))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the names of those they break. A rule that is null is broken."""
    tagged = df.withColumn("_broken", F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()))))
    return tagged.filter(F.size("_broken") == 0).drop("_broken"), tagged.filter(F.size("_broken") > 0).withColumn("reason", F.array_join("_broken", ",")).drop("_broken")


def load_in_batches(spark: SparkSession, source: DataFrame, key: str, path: str, batches: int, work: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Write source in batches by a hash of the key, each a folder of its own; work(batch, number) makes what is written.

    The source is read once, into a folder with a part for each batch beside the path, which goes when all batches are through. A batch that fails is
    logged with its error, keeps its part there and holds none of the others up; the next call takes up what has no success file yet. batch_log reads the log.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    staged = f"{path}-staged"
    todo = [b for b in range(batches) if not fs.exists(hadoop(f"{path}/batch={b}/_SUCCESS"))]
    if todo and not fs.exists(hadoop(f"{staged}/_SUCCESS")):
        source.withColumn("_batch", F.pmod(F.xxhash64(key), F.lit(batches)).cast("int")).write.mode("overwrite").partitionBy("_batch").parquet(staged)
    failed = 0
    for b in todo:
        folder = f"{path}/batch={b}"
        part = spark.read.schema(source.select("*", F.lit(b).alias("_batch")).schema).parquet(staged).filter(F.col("_batch") == b).drop("_batch")
        try:
            (work(part, b) if work else part).write.mode("overwrite").parquet(folder)
            row = (b, "done", spark.read.parquet(folder).count(), None)
        except Exception as e:  # whatever a batch's own work raises
            failed += 1
            row = (b, "failed", None, str(e)[:1000])
        spark.createDataFrame([row], _LOG).coalesce(1).write.mode("append").parquet(f"{path}-log")
    if todo and not failed:
        fs.delete(hadoop(staged), True)
    return spark.read.option("basePath", path).parquet(*[f"{path}/batch={b}" for b in range(batches) if fs.exists(hadoop(f"{path}/batch={b}/_SUCCESS"))]) if failed < batches else source.limit(0).withColumn("batch", F.lit(0))


_LOG = "batch int, status string, n_rows long, error string"


def batch_log(spark: SparkSession, path: str) -> DataFrame:
    """A row for each attempt at a batch of load_in_batches."""
    return spark.read.schema(_LOG).parquet(f"{path}-log")


def save_version(df: DataFrame, path: str, version: int) -> None:
    df.write.mode("errorifexists").parquet(f"{path}/version={version}")


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, or the newest one."""
    df = spark.read.option("basePath", path).parquet(path)
    if version is None:
        version = df.agg(F.max("version")).first()[0]
    return df.filter(F.col("version") == version).drop("version")


_MANIFEST = "entry long, version long, at timestamp, action string, note string"


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _entry(spark: SparkSession, path: str, entry: int, version: int, at: str | None, action: str, note: str | None) -> None:
    """An entry is a folder of its own that must not be there yet: of two writers with the same number one fails."""
    time = F.lit(at).cast("timestamp") if at else F.current_timestamp()
    row = spark.range(1).select(F.lit(entry).cast("long").alias("entry"), F.lit(version).cast("long").alias("version"), time.alias("at"), F.lit(action).alias("action"), F.lit(note).cast("string").alias("note"))
    row.coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/{entry}")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a versioned table: a row for each commit and each roll back. The last one names the current version."""
    fs, place = _folder(spark, f"{path}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest/*") if fs.exists(place) else spark.createDataFrame([], _MANIFEST)


def commit(df: DataFrame, path: str, at: str | None = None, note: str | None = None) -> int:
    """Write df as the next version and make it the current one; its number. The data is there before the entry that names it, so readers see all or nothing of it."""
    spark = df.sparkSession
    log = manifest(spark, path).agg(F.coalesce(F.max("entry"), F.lit(0)), F.coalesce(F.max("version"), F.lit(0))).first()
    entry, version = log[0] + 1, log[1] + 1
    df.write.mode("overwrite").parquet(f"{path}/data/{version}-{entry}")
    _entry(spark, path, entry, version, at, "commit", note)
    return version


def roll_back(spark: SparkSession, path: str, version: int, at: str | None = None, note: str | None = None) -> None:
    """Make an earlier version the current one; what came later stays readable by number and time."""
    log = manifest(spark, path)
    if not log.filter((F.col("version") == version) & (F.col("action") == "commit")).limit(1).count():
        raise ValueError(f"no version {version}")
    _entry(spark, path, log.agg(F.max("entry")).first()[0] + 1, version, at, "roll back", note)


def as_of(spark: SparkSession, path: str, version: int | None = None, time: str | None = None) -> DataFrame:
    """A versioned table: of a version, as it was at a time, or as it is."""
    log = manifest(spark, path)
    if version is not None:
        found = log.filter((F.col("version") == version) & (F.col("action") == "commit"))
    else:
        now = log.filter(F.col("at") <= F.lit(time).cast("timestamp")) if time else log
        last = now.agg(F.max_by("version", "entry")).first()[0]
        found = log.filter((F.col("version") == last) & (F.col("action") == "commit"))
    row = found.agg(F.max_by(F.struct("entry", "version"), "entry").alias("x")).first().x
    if row is None:
        raise ValueError(f"no version {version}" if version is not None else f"nothing was there at {time or 'any time'}")
    return spark.read.parquet(f"{path}/data/{row.version}-{row.entry}")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove the data of all versions but the current one and the `keep` newest, and what failed commits left; how many folders went. The manifest stays."""
    log = manifest(spark, path)
    current = log.agg(F.max_by("version", "entry")).first()[0]
    commits = log.filter("action = 'commit'").select("version", "entry").orderBy(F.desc("version")).limit(keep).collect() + log.filter((F.col("action") == "commit") & (F.col("version") == current)).select("version", "entry").collect()
    held = {f"{r.version}-{r.entry}" for r in commits}
    fs, place = _folder(spark, f"{path}/data")
    gone = [f.getPath() for f in fs.listStatus(place) if f.getPath().getName() not in held]
    for p in gone:
        fs.delete(p, True)
    return len(gone)


def feature_table(df: DataFrame, keys: list[str]) -> DataFrame:
    """df if its keys are unique and not null, else an error that names the count of offending rows."""
    w = Window.partitionBy(*keys)
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    bad = df.withColumn("_n", F.count("*").over(w)).filter(any_null | (F.col("_n") > 1)).count()
    if bad:
        raise ValueError(f"{bad} rows with a null or repeated key {keys}")
    return df
