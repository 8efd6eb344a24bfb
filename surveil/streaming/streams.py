"""Structured Streaming: ingestion, windows, and a retry queue. Checkpoints go to a path that the caller names."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import delete_keys, upsert


def files(spark: SparkSession, path: str, schema, kind: str = "parquet", per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.format(kind).schema(schema)
    return (r.option("maxFilesPerTrigger", per_batch) if per_batch else r).load(path)


def run_once(df: DataFrame, out: str, checkpoint: str, by: list[str] | None = None) -> StreamingQuery:
    """Append all that is there and stop; a rerun with the same checkpoint adds only what is new."""
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    q = (w.partitionBy(*by) if by else w).start()
    q.awaitTermination()
    return q


def every(df: DataFrame, out: str, checkpoint: str, seconds: int = 30, by: list[str] | None = None) -> StreamingQuery:
    w = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds")
    return (w.partitionBy(*by) if by else w).start()


def batches(df: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    q = df.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def newest_result(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """The result of a streaming aggregate after all that is there: each batch writes it whole, under the batch's number."""
    done: list[int] = []

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        done.append(number)

    q = df.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.parquet(f"{out}/{done[-1]}")


def from_json_events(raw: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Permissive: a text that is no such object gives null fields, and is kept."""
    return raw.select(F.from_json(F.col(column).cast("string"), schema, {"mode": "PERMISSIVE"}).alias("e"), F.col(column).alias("raw")).select("e.*", "raw")


def tumbling(df: DataFrame, time: str, keys: list[str], size: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return df.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def sessions(df: DataFrame, time: str, keys: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    return df.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def once_each(df: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key. A key is forgotten when the watermark has passed its row by `late`; later rows than that are dropped."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


@dataclass
class RowRule:
    """A SQL condition that rows must meet (null: broken), the share that may break it, and how bad it is otherwise."""

    name: str
    sql: str
    mostly: float = 0.0
    severity: str = "ERROR"


@dataclass
class KnownKey:
    """Values of a column must be in a table (null: broken)."""

    name: str
    column: str
    table: DataFrame
    key: str
    mostly: float = 0.0
    severity: str = "ERROR"


def checked(df: DataFrame, rules: list[RowRule | KnownKey], out: str, checkpoint: str) -> StreamingQuery:
    """Write a stream to out/data and a verdict for each batch and rule to out/verdicts; both by one pass over the batch, whose metrics are observed on the way.

    A batch has a folder of its own in both, so that a batch that is repeated after a failure replaces what it wrote.
    """
    columns = df.columns

    def save(batch: DataFrame, number: int) -> None:
        for i, r in enumerate(rules):
            if isinstance(r, KnownKey):
                known = r.table.select(F.col(r.key).alias(f"_k{i}")).filter(F.col(f"_k{i}").isNotNull()).distinct().withColumn(f"_in{i}", F.lit(True))
                batch = batch.join(known, F.col(r.column) == F.col(f"_k{i}"), "left")
        ok = [F.expr(r.sql) if isinstance(r, RowRule) else F.col(f"_in{i}") for i, r in enumerate(rules)]
        seen = Observation(f"rules-{number}")
        broken = [F.count_if(~F.coalesce(c, F.lit(False))).alias(f"b{i}") for i, c in enumerate(ok)]
        batch.observe(seen, F.count(F.lit(1)).alias("n"), *broken).select(*columns).write.mode("overwrite").parquet(f"{out}/data/batch={number}")
        got = seen.get
        n = got["n"]
        rows = [(number, r.name, n, got[f"b{i}"], "PASS" if got[f"b{i}"] <= r.mostly * n else "FAIL", r.severity) for i, r in enumerate(rules)]
        verdicts = batch.sparkSession.createDataFrame(rows, "batch long, rule string, n_rows long, n_broken long, status string, severity string")
        verdicts.drop("batch").coalesce(1).write.mode("overwrite").parquet(f"{out}/verdicts/batch={number}")

    return batches(df, save, checkpoint)


def alerts(df: DataFrame, rules: dict[str, Column], keep: list[str]) -> DataFrame:
    """One row per event and rule that it meets; stateless."""
    return df.select(*keep, F.explode(F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))).alias("alert"))


def retry_round(queue: DataFrame, new: DataFrame, ok: Column, now: Column, most: int = 5, base: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round of a retry queue: (queue after it, successes, dead letters).

    queue: sample_id, payload, retry_count, process_after; new: sample_id, payload. Due rows and new ones are tried: ok says which
    succeed. A failure waits base^n minutes for its n-th retry; after `most` of them it is dead. Successes and dead letters leave the queue.
    """
    due = queue.filter(F.col("process_after") <= now)
    tried = due.unionByName(new, allowMissingColumns=True).withColumn("retry_count", F.coalesce("retry_count", F.lit(0))).withColumn("_ok", F.coalesce(ok, F.lit(False)))
    done = tried.filter("_ok").select("sample_id", "payload")
    failed = tried.filter("not _ok").withColumn("retry_count", F.col("retry_count") + 1)
    dead = failed.filter(F.col("retry_count") > most).select("sample_id", "payload", "retry_count")
    wait = failed.filter(F.col("retry_count") <= most).withColumn("process_after", now + F.make_interval(mins=F.pow(F.lit(base), F.col("retry_count")).cast("int"))).select(queue.columns)
    left = delete_keys(queue, done.select("sample_id").unionByName(dead.select("sample_id")), ["sample_id"])
    return upsert(left, wait, ["sample_id"]), done, dead
